"""Keyed lists ``(key, pos, value)``: positions are unique per key and may have gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ranking import rank_slice, top_per_key, with_rank


def push(df: DataFrame, rows: DataFrame, side: str = "right", seq: str = "seq", only_existing: bool = False, buckets: int | None = None) -> DataFrame:
    """Add ``rows(key, value, seq)`` one after the other on the left or right."""
    ends = df.groupBy("key").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    ranked = with_rank(rows, ["key"], [seq], "_n", "_size", buckets)
    placed = ranked.join(ends, "key", "inner" if only_existing else "left")
    if side == "right":
        at = F.coalesce(F.col("_last"), F.lit(-1)) + 1 + F.col("_n")
    elif side == "left":
        at = F.coalesce(F.col("_first"), F.lit(0)) - 1 - F.col("_n")
    else:
        raise ValueError("side is left or right")
    return df.select("key", "pos", "value").unionByName(placed.select("key", at.cast("long").alias("pos"), "value"))


def llen(df: DataFrame) -> DataFrame:
    return df.groupBy("key").agg(F.count(F.lit(1)).alias("size"))


def lrange(df: DataFrame, start: int, stop: int, buckets: int | None = None) -> DataFrame:
    """Items at indexes ``start..stop``, both included, negatives from the end, with ``index``."""
    return rank_slice(df, ["key"], ["pos"], start, stop, rank="index", buckets=buckets)


def ltrim(df: DataFrame, start: int, stop: int, buckets: int | None = None) -> DataFrame:
    return lrange(df, start, stop, buckets).select("key", "pos", "value")


def lindex(df: DataFrame, index: int, buckets: int | None = None) -> DataFrame:
    """The item at ``index`` of each list; a negative index counts from the end."""
    if index >= 0:
        return rank_slice(df, ["key"], ["pos"], index, index, rank="index", buckets=buckets)
    at = -index - 1
    tail = rank_slice(df, ["key"], ["pos"], at, at, reverse=True, rank="_back", buckets=buckets)
    return tail.withColumn("index", F.lit(index).cast("long")).drop("_back")


def lset(df: DataFrame, index: int, value: Column, buckets: int | None = None) -> DataFrame:
    """Replace the value at ``index``; lists that are too short stay."""
    target = lindex(df, index, buckets).select("key", "pos", F.lit(True).alias("_hit"))
    return df.join(target, ["key", "pos"], "left").select(
        "key", "pos", F.when(F.col("_hit"), value).otherwise(F.col("value")).alias("value")
    )


def lrem(df: DataFrame, value, n: int = 0, buckets: int | None = None) -> DataFrame:
    """Drop the first ``n`` items equal to ``value``, the last ``-n``, or all for 0."""
    equal = F.col("value") == value
    if n == 0:
        return df.filter(~F.coalesce(equal, F.lit(False)))
    gone = rank_slice(df.filter(equal), ["key"], ["pos"], 0, abs(n) - 1, reverse=n < 0, rank="_n", buckets=buckets)
    return df.join(gone.select("key", "pos"), ["key", "pos"], "left_anti").select("key", "pos", "value")


def linsert(df: DataFrame, pivot, value, before: bool = True) -> DataFrame:
    """Put ``value`` before or after the first ``pivot`` of each list that has one."""
    at = F.min(F.when(F.col("value") == pivot, F.col("pos"))).alias("_at")
    pivots = df.groupBy("key").agg(at).filter(F.col("_at").isNotNull())
    slot = F.col("_at") if before else F.col("_at") + 1
    moved = df.join(pivots, "key", "left").select(
        "key", (F.col("pos") + F.when(F.col("pos") >= slot, 1).otherwise(0)).cast("long").alias("pos"), "value"
    )
    return moved.unionByName(pivots.select("key", slot.cast("long").alias("pos"), F.lit(value).alias("value")))


def pop(df: DataFrame, n: int = 1, side: str = "left") -> tuple[DataFrame, DataFrame]:
    """The first (or last) ``n`` items of each list, and the lists without them."""
    order = F.col("pos").asc() if side == "left" else F.col("pos").desc()
    taken = top_per_key(df, ["key"], [order], n, rank="nth")
    rest = df.join(taken.select("key", "pos"), ["key", "pos"], "left_anti").select("key", "pos", "value")
    return taken, rest


def rotate(df: DataFrame, source: str, target: str) -> DataFrame:
    """Move the last item of ``source`` to the head of ``target``, which may be the same list."""
    last = df.filter(F.col("key") == source).agg(F.max("pos")).scalar()
    head = df.filter(F.col("key") == target).agg(F.coalesce(F.min("pos"), F.lit(0))).scalar()
    hit = (F.col("key") == source) & F.coalesce(F.col("pos") == last, F.lit(False))
    return df.select(
        F.when(hit, F.lit(target)).otherwise(F.col("key")).alias("key"),
        F.when(hit, head - 1).otherwise(F.col("pos")).cast("long").alias("pos"),
        "value",
    )


def renumber(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """Positions made dense from 0."""
    ranked = with_rank(df, ["key"], ["pos"], "_n", "_size", buckets)
    return ranked.select("key", F.col("_n").alias("pos"), "value")
