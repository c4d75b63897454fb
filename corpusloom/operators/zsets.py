"""Sorted sets ``(key, member, score)``; the order is (score, member bytes)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import merge
from corpusloom.operators.ranking import rank_slice, slice_bounds, with_rank

ORDER = ("score", "member")


def _no_nan(value: Column) -> Column:
    return F.nanvl(value, F.lit(0.0))


def zcombine(
    df: DataFrame,
    keys: Sequence[str],
    weights: Sequence[float] | None = None,
    aggregate: str = "sum",
    mode: str = "union",
) -> DataFrame:
    """Union or intersection of sorted sets with weighted scores: ``(member, score)``.

    Plain sets take part with score 1 where the score is null.  A key may be
    named twice.  NaN from weight times score or from inf - inf becomes 0.
    """
    weights = list(weights or [1.0] * len(keys))
    if len(weights) != len(keys):
        raise ValueError("one weight per key")
    by_key: dict[str, list[float]] = defaultdict(list)
    for key, weight in zip(keys, weights):
        by_key[key].append(float(weight))
    of_key = F.create_map(
        *[part for key, ws in by_key.items() for part in (F.lit(key), F.array(*[F.lit(w) for w in ws]))]
    )
    scored = df.filter(F.col("key").isin(list(by_key))).select(
        "member", F.coalesce(F.col("score"), F.lit(1.0)).alias("score"), F.explode(of_key[F.col("key")]).alias("weight")
    )
    value = _no_nan(F.col("score") * F.col("weight"))
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[aggregate]
    grouped = scored.groupBy("member").agg(_no_nan(fold(value)).alias("score"), F.count(F.lit(1)).alias("_n"))
    if mode == "inter":
        grouped = grouped.filter(F.col("_n") == len(keys))
    return grouped.select("member", "score")


def zrank(df: DataFrame, reverse: bool = False, buckets: int | None = None) -> DataFrame:
    """Every member with its zero-based ``rank``."""
    ranked = with_rank(df, ["key"], ORDER, "rank", "_size", buckets)
    if reverse:
        ranked = ranked.withColumn("rank", F.col("_size") - 1 - F.col("rank"))
    return ranked.drop("_size")


def zrange(df: DataFrame, start: int, stop: int, reverse: bool = False, buckets: int | None = None) -> DataFrame:
    """Members at positions ``start..stop``, both included, negatives from the end."""
    return rank_slice(df, ["key"], ORDER, start, stop, reverse, "rank", buckets)


def score_between(
    low: float = float("-inf"), high: float = float("inf"), low_open: bool = False, high_open: bool = False
) -> Column:
    score = F.col("score")
    return (score > low if low_open else score >= low) & (score < high if high_open else score <= high)


def lex_between(low: str = "-", high: str = "+") -> Column:
    """Member range: ``-`` and ``+`` are the ends, ``[x`` includes x and ``(x`` does not."""
    member = F.col("member")

    def bound(text: str, including, excluding) -> Column:
        if text[:1] not in ("[", "("):
            raise ValueError("a bound is -, +, [text or (text")
        return including(text[1:]) if text[0] == "[" else excluding(text[1:])

    if low == "+" or high == "-":
        return F.lit(False)
    test = F.lit(True)
    if low != "-":
        test = test & bound(low, lambda v: member >= v, lambda v: member > v)
    if high != "+":
        test = test & bound(high, lambda v: member <= v, lambda v: member < v)
    return test


def _limited(df: DataFrame, reverse: bool, offset: int, count: int | None, buckets: int | None) -> DataFrame:
    """Rows of each key in order, ``count`` of them after ``offset``."""
    if count is None and offset == 0:
        return df
    stop = -1 if count is None or count < 0 else offset + count - 1
    if stop != -1 and stop < offset:
        return df.limit(0)
    return rank_slice(df, ["key"], ORDER, offset, stop, reverse, "_at", buckets).drop("_at")


def zrange_by_score(
    df: DataFrame,
    low: float = float("-inf"),
    high: float = float("inf"),
    low_open: bool = False,
    high_open: bool = False,
    offset: int = 0,
    count: int | None = None,
    reverse: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    return _limited(df.filter(score_between(low, high, low_open, high_open)), reverse, offset, count, buckets)


def zrange_by_lex(
    df: DataFrame,
    low: str = "-",
    high: str = "+",
    offset: int = 0,
    count: int | None = None,
    reverse: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    return _limited(df.filter(lex_between(low, high)), reverse, offset, count, buckets)


def zcount(df: DataFrame, test: Column) -> DataFrame:
    """Members per key that satisfy a score or member range."""
    return df.groupBy("key").agg(F.count_if(test).alias("count"))


def zadd(df: DataFrame, changes: DataFrame, mode: str = "upsert", seq: str = "seq") -> DataFrame:
    """Set scores: ``upsert`` all, ``nx`` only new members, ``xx`` only known ones, ``incr`` adds to the score."""
    keys = ["key", "member"]
    if mode == "incr":
        both = df.select(*keys, "score").unionByName(changes.select(*keys, "score"))
        total = F.sum("score")
        checked = F.when(F.isnan(total), F.raise_error(F.lit("resulting score is not a number")).cast("double"))
        return both.groupBy(*keys).agg(checked.otherwise(total).alias("score"))
    how = {"upsert": merge.upsert, "nx": merge.insert_absent, "xx": merge.update_present}[mode]
    return how(df, changes, keys, seq)


def zadd_changed(df: DataFrame, changes: DataFrame, mode: str = "upsert", seq: str = "seq") -> DataFrame:
    """Members added or changed by ``zadd`` per key: ``(key, added, changed)``."""
    after = zadd(df, changes, mode, seq)
    old = df.select("key", "member", F.col("score").alias("_old"), F.lit(True).alias("_had"))
    both = after.join(old, ["key", "member"], "left")
    new = F.col("_had").isNull()
    return both.groupBy("key").agg(
        F.count_if(new).alias("added"), F.count_if(~new & (F.col("score") != F.col("_old"))).alias("changed")
    )


def zrem(df: DataFrame, rows: DataFrame) -> DataFrame:
    return merge.delete_keys(df, rows, ["key", "member"])


def zscore(df: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.join(df.select("key", "member", "score"), ["key", "member"], "left")


def zrem_range_by_rank(df: DataFrame, start: int, stop: int, buckets: int | None = None) -> DataFrame:
    """The sets without positions ``start..stop``."""
    ranked = with_rank(df, ["key"], ORDER, "_rank", "_size", buckets)
    low, high = slice_bounds(start, stop, F.col("_size"))
    return ranked.filter(~F.col("_rank").between(low, high)).select(*df.columns)


def zrem_range(df: DataFrame, test: Column) -> DataFrame:
    """The sets without the members of a score or member range."""
    return df.filter(~test)
