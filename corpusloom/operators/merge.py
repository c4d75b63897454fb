"""Batch merges of keyed tables: the last change of a key wins.

Every function returns the new version of the table; writing it to a new path
and moving the view is ``sources.tables.publish``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _others(df: DataFrame, *out: Sequence[str]) -> list[str]:
    gone = {name for names in out for name in names}
    return [c for c in df.columns if c not in gone]


def newest(changes: DataFrame, keys: Sequence[str], seq: str, first: bool = False) -> DataFrame:
    """One row per key, that of the highest (or lowest) ``seq``.

    An aggregate, so each map task folds a frequent key to one row before the shuffle.
    """
    rest = _others(changes, keys, [seq])
    pick = F.min_by if first else F.max_by
    # a constant field keeps the struct valid when the table has only keys
    row = F.struct(F.lit(True).alias("_there"), *rest)
    return (
        changes.groupBy(*keys)
        .agg(pick(row, F.col(seq)).alias("_row"))
        .select(*keys, *[F.col("_row")[name].alias(name) for name in rest])
    )


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Insert or replace whole rows by key."""
    last = newest(changes, keys, seq)
    return base.join(last.select(*keys), list(keys), "left_anti").unionByName(last, allowMissingColumns=True)


def insert_absent(base: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Keep existing rows; a key that is absent gets its first change."""
    first = newest(changes, keys, seq, first=True)
    return base.unionByName(
        first.join(base.select(*keys), list(keys), "left_anti"), allowMissingColumns=True
    )


def insert_all_or_none(base: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Insert all changes, or none of them if any key exists already."""
    last = newest(changes, keys, seq)
    taken = last.select(*keys).join(base.select(*keys), list(keys), "left_semi")
    return base.unionByName(last.filter(~taken.exists()), allowMissingColumns=True)


def update_present(base: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Replace rows whose key exists; other changes are dropped."""
    last = newest(changes, keys, seq).join(base.select(*keys), list(keys), "left_semi")
    return base.join(last.select(*keys), list(keys), "left_anti").unionByName(last, allowMissingColumns=True)


def partial_update(base: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Replace only the fields that a change gives (a null field is not given).

    Several changes of one row are folded field by field, later ones over earlier ones.
    """
    fields = _others(changes, keys, [seq])
    folded = changes.groupBy(*keys).agg(
        *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(seq))).alias(f"_new_{f}") for f in fields]
    )
    joined = base.join(folded, list(keys), "left")

    def value(name: str) -> Column:
        if name not in fields:
            return F.col(name)
        return F.coalesce(F.col(f"_new_{name}"), F.col(name)).alias(name)

    added = [F.col(f"_new_{f}").alias(f) for f in fields if f not in base.columns]
    return joined.select(*[value(c) for c in base.columns], *added)


def absent_keys(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of changes that no row of the table has."""
    return changes.select(*keys).distinct().join(base.select(*keys), list(keys), "left_anti")


def delete_keys(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(gone.select(*keys), list(keys), "left_anti")


def rename_key(df: DataFrame, source: str, target: str, key: str = "key", only_new: bool = False) -> DataFrame:
    """Rows of ``source`` become those of ``target``, whose old rows are dropped.

    Nothing changes if ``source`` is absent, or with ``only_new`` if ``target`` exists.
    """
    if source == target:
        return df
    at = F.col(key)
    possible = df.filter(at == source).exists()
    if only_new:
        possible = possible & ~df.filter(at == target).exists()
    replaced = (at == target) & possible
    moved = F.when((at == source) & possible, F.lit(target)).otherwise(at)
    return df.filter(~replaced).withColumn(key, moved)


def move_keys(df: DataFrame, keys: DataFrame, source: str, target: str, space: str = "db", key: str = "key") -> DataFrame:
    """Move keys to another key space where they do not exist yet."""
    there = df.filter(F.col(space) == target).select(F.col(key))
    movable = keys.select(key).distinct().join(there, key, "left_anti").withColumn("_move", F.lit(True))
    hit = F.coalesce(F.col("_move"), F.lit(False)) & (F.col(space) == source)
    return (
        df.join(movable, key, "left")
        .withColumn(space, F.when(hit, F.lit(target)).otherwise(F.col(space)))
        .select(*df.columns)
    )


def counters(deltas: DataFrame, keys: Sequence[str], delta: str = "delta", base: DataFrame | None = None) -> DataFrame:
    """Counter values after all deltas: 64-bit overflow, NaN and infinity are errors."""
    if base is not None:
        deltas = base.select(*keys, F.col("value").alias(delta)).unionByName(deltas.select(*keys, delta))
    whole = dict(deltas.dtypes)[delta] in ("tinyint", "smallint", "int", "bigint")
    if whole:
        total = F.try_sum(F.col(delta).cast("long"))
        checked = F.when(total.isNull() & (F.count(delta) > 0), F.raise_error(F.lit("counter would overflow")).cast("long"))
    else:
        total = F.sum(F.col(delta))
        bad = F.isnan(total) | (F.abs(total) == float("inf"))
        checked = F.when(bad, F.raise_error(F.lit("counter would be NaN or infinite")).cast("double"))
    return deltas.groupBy(*keys).agg(checked.otherwise(total).alias("value"))


def upsert_visited(visited: DataFrame, fingerprints: DataFrame, now: Column) -> DataFrame:
    """Insert fingerprints, or refresh their ``last_time``."""
    fresh = fingerprints.select("fingerprint", now.cast("timestamp").alias("last_time"))
    both = visited.select("fingerprint", F.col("last_time").cast("timestamp")).unionByName(fresh)
    return both.groupBy("fingerprint").agg(F.max("last_time").alias("last_time"))
