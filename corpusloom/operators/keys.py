"""Keys, strings and hashes: lookups, tests, scans, expiry.

Tables are ``(key, value)`` or ``(key, field, value)``; a typed key table also
has ``type`` and ``expire_at``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import strings
from corpusloom.operators import merge
from corpusloom.operators.crawl import random_order
from corpusloom.operators.joins import salted_join
from corpusloom.operators.ranking import with_rank

RUN = 1024  # chunks that are joined before the runs of a key meet


def lookup(df: DataFrame, asked: DataFrame, on: Sequence[str] = ("key",)) -> DataFrame:
    """Values of the asked keys, null if absent; extra columns of ``asked`` keep its order.

    A key that is asked for very often is spread over tasks by the other columns of ``asked``.
    """
    others = [f.name for f in asked.schema if f.name not in on and "map<" not in f.dataType.simpleString()]
    if not others:
        return asked.join(df, list(on), "left")
    return salted_join(asked, df, list(on), others, "left")


def exists(df: DataFrame, asked: DataFrame, on: Sequence[str] = ("key",)) -> DataFrame:
    """``asked`` with a 0/1 column ``found``."""
    there = df.select(*on).distinct().withColumn("_there", F.lit(1))
    return asked.join(there, list(on), "left").select(
        *asked.columns, F.coalesce("_there", F.lit(0)).cast("long").alias("found")
    )


def key_types(asked: DataFrame, **tables: DataFrame) -> DataFrame:
    """The type of each asked key: the name of the table that holds it, else ``none``."""
    named = None
    for kind, table in tables.items():
        part = table.select("key").distinct().withColumn("type", F.lit(kind))
        named = part if named is None else named.unionByName(part)
    return asked.join(named, "key", "left").select(*asked.columns, F.coalesce("type", F.lit("none")).alias("type"))


def scan(df: DataFrame, pattern: str, column: str = "key") -> DataFrame:
    """Rows whose key, member or field matches a glob."""
    return df.filter(strings.glob_match(F.col(column), pattern))


def keys_matching(df: DataFrame, pattern: str) -> DataFrame:
    return scan(df.select("key"), pattern).distinct()


def dbsize(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("key").alias("keys"))


def hgetall(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Entries as rows, so that one very large hash stays spread over tasks."""
    kept = df if keys is None else df.filter(F.col("key").isin(list(keys)))
    return kept.select("key", "field", "value")


def hkeys(df: DataFrame) -> DataFrame:
    return df.select("key", "field")


def hvals(df: DataFrame) -> DataFrame:
    return df.select("key", "value")


def hlen(df: DataFrame) -> DataFrame:
    return df.groupBy("key").agg(F.count(F.lit(1)).alias("size"))


def hset(df: DataFrame, changes: DataFrame, mode: str = "upsert", seq: str = "seq") -> DataFrame:
    how = {"upsert": merge.upsert, "nx": merge.insert_absent, "xx": merge.update_present}[mode]
    return how(df, changes, ["key", "field"], seq)


def hdel(df: DataFrame, rows: DataFrame) -> DataFrame:
    return merge.delete_keys(df, rows, ["key", "field"])


def set_values(df: DataFrame, changes: DataFrame, mode: str = "upsert", seq: str = "seq") -> DataFrame:
    """String writes: ``upsert``, ``nx`` only absent, ``xx`` only present, ``all_nx`` all or none.

    A changed key takes the expiry of its change, so a plain write clears it.
    """
    how = {
        "upsert": merge.upsert,
        "nx": merge.insert_absent,
        "xx": merge.update_present,
        "all_nx": merge.insert_all_or_none,
    }[mode]
    return how(df, changes, ["key"], seq)


def getset(df: DataFrame, changes: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The old values of the changed keys, and the new table."""
    return lookup(df.select("key", "value"), changes.select("key").distinct()), set_values(df, changes, seq=seq)


def append_rows(base: DataFrame, chunks: DataFrame, seq: str = "seq", limit: int = strings.MAX_BYTES) -> DataFrame:
    """Values with all chunks of their key appended in order.

    A value may not exceed ``limit`` bytes, which is checked on the summed
    lengths before any chunks of a key are brought together.  Empty chunks are
    dropped, and runs of ``RUN`` chunks are joined before the runs of a key meet,
    so what meets is as large as the value itself.
    """
    rows = base.select("key", "value", F.lit(None).cast("long").alias("_s")).unionByName(
        chunks.filter(F.octet_length("value") > 0).select("key", "value", F.col(seq).cast("long").alias("_s"))
    )
    silent = chunks.select("key").distinct().join(rows.select("key").distinct(), "key", "left_anti")
    rows = rows.unionByName(silent.select("key", F.lit("").alias("value"), F.lit(0).cast("long").alias("_s")))
    size = rows.groupBy("key").agg(F.sum(F.octet_length("value")).alias("_bytes"))
    too_long = F.raise_error(F.lit("string exceeds the maximum size")).cast("boolean")
    checked = rows.join(size.filter(F.when(F.col("_bytes") > limit, too_long).otherwise(F.lit(True))), "key")
    ordered = checked.select("key", "value", F.coalesce("_s", F.lit(-(2**63))).alias("_s"))
    ranked = with_rank(ordered, ["key"], ["_s", "value"], "_i", "_size")

    def joined(order: str, of: DataFrame, *by: str) -> DataFrame:
        pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), "value")))
        return of.groupBy(*by).agg(F.array_join(F.transform(pieces, lambda c: c["value"]), "").alias("value"))

    runs = joined("_i", ranked.withColumn("_run", F.floor(F.col("_i") / RUN)), "key", "_run")
    return joined("_run", runs, "key")


def with_expiry(df: DataFrame, expiry: DataFrame) -> DataFrame:
    """Set ``expire_at`` of the named keys (null makes a key lasting again)."""
    named = expiry.select("key", F.col("expire_at").alias("_at"), F.lit(True).alias("_named"))
    old = F.col("expire_at") if "expire_at" in df.columns else F.lit(None).cast("timestamp")
    joined = df.join(named, "key", "left")
    rest = [c for c in df.columns if c != "expire_at"]
    return joined.select(*rest, F.when(F.col("_named"), F.col("_at")).otherwise(old).alias("expire_at"))


def live(df: DataFrame, now: Column, expire_at: str = "expire_at") -> DataFrame:
    """Rows whose key has not expired; a plain comparison that Parquet statistics can use."""
    return df.filter(F.col(expire_at).isNull() | (F.col(expire_at) >= now))


def ttl_of(asked: DataFrame, df: DataFrame, now: Column, unit: str = "s") -> DataFrame:
    """Time to live of each asked key: -2 absent, -1 lasting."""
    known = df.select("key", "expire_at", F.lit(True).alias("_there"))
    left = asked.join(known, "key", "left")
    return left.select(*asked.columns, strings.ttl(F.col("_there"), F.col("expire_at"), now, unit).alias("ttl"))


def random_key(df: DataFrame, seed: int = 0) -> DataFrame:
    return df.select("key").distinct().orderBy(random_order(F.col("key"), seed), "key").limit(1)


def in_order(asked: DataFrame, order: str = "ord") -> DataFrame:
    """Rows of a key list in its order (a total sort, spread over ranges)."""
    return asked.orderBy(order)

