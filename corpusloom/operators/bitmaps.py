"""Bit arrays as rows ``(key, bit)``: a row is a bit that is set.

Bit 0 is the most significant bit of byte 0.  Repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ranking import with_rank
from corpusloom.operators.sets import _presence


def setbit(df: DataFrame, changes: DataFrame, seq: str = "seq") -> DataFrame:
    """Apply ``changes(key, bit, on)``; the last change of a bit wins."""
    last = changes.groupBy("key", "bit").agg(F.max_by(F.col("on"), F.col(seq)).alias("_on"))
    kept = df.select("key", "bit").distinct().join(last, ["key", "bit"], "left_anti")
    return kept.unionByName(last.filter(F.col("_on") == 1).select("key", "bit"))


def getbit(df: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(key, bit)`` with the 0/1 column ``on``."""
    there = df.select("key", "bit").distinct().withColumn("_on", F.lit(1))
    return asked.join(there, ["key", "bit"], "left").select(
        *asked.columns, F.coalesce("_on", F.lit(0)).cast("long").alias("on")
    )


def spans(df: DataFrame) -> DataFrame:
    """Length in bytes of each array: it ends with the byte of its last set bit."""
    return df.groupBy("key").agg((F.floor(F.max("bit") / 8) + 1).cast("long").alias("n_bytes"))


def _byte_bounds(start: int, end: int):
    size = F.col("n_bytes")
    low = F.lit(start) if start >= 0 else F.greatest(size + start, F.lit(0))
    high = F.least(F.lit(end) if end >= 0 else F.greatest(size + end, F.lit(0)), size - 1)
    backwards = F.lit(start < 0 and end < 0 and start > end)
    return low, high, backwards


def bitcount(df: DataFrame, start: int = 0, end: int = -1) -> DataFrame:
    """Set bits per key in bytes ``start..end``, both included, negatives from the end.

    Bits are packed into bitmaps per (key, bucket) first, so repeated rows fold
    in the map tasks and a large array is counted in many groups.
    """
    rows = df.select("key", "bit")
    if (start, end) != (0, -1):
        low, high, backwards = _byte_bounds(start, end)
        byte = F.floor(F.col("bit") / 8)
        inside = (byte >= low) & (byte <= high) & ~backwards
        rows = rows.join(spans(df), "key").select("key", F.when(inside, F.col("bit")).alias("bit"))
    packed = rows.groupBy("key", F.bitmap_bucket_number("bit").alias("_b")).agg(
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("bit"))).alias("_n")
    )
    return packed.groupBy("key").agg(F.sum("_n").alias("bits"))


def bitop(df: DataFrame, op: str, keys: Sequence[str]) -> DataFrame:
    """Bits of ``and``, ``or``, ``xor`` over arrays, or ``not`` of one: ``(bit)``.

    Shorter arrays count as padded with zeros; ``not`` covers the array's bytes.
    """
    rows = df.select("key", F.col("bit").alias("member"))
    if op == "not":
        (key,) = keys
        own = df.filter(F.col("key") == key).select("bit").distinct()
        blocks = spans(df.filter(F.col("key") == key)).select(
            F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / 4096))).alias("_block"), "n_bytes"
        )
        first = F.col("_block") * 32768
        last = F.least(first + 32767, F.col("n_bytes") * 8 - 1)
        every = blocks.repartition("_block").select(F.explode(F.sequence(first, last)).alias("bit"))
        return every.join(own, "bit", "left_anti")
    if op == "or":
        return rows.filter(F.col("key").isin(list(keys))).select(F.col("member").alias("bit")).distinct()
    if op not in ("and", "xor"):
        raise ValueError(f"unknown operation {op!r}")
    if op == "xor":
        odd = [k for k in dict.fromkeys(keys) if list(keys).count(k) % 2]
        if not odd:
            return rows.select(F.col("member").alias("bit")).limit(0)
        grouped, words, _ = _presence(rows, odd)
        ones = sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0]))
        return grouped.filter(ones % 2 == 1).select(F.col("member").alias("bit"))
    grouped, words, full = _presence(rows, keys)
    for word, mask in zip(words, full):
        grouped = grouped.filter(word == mask)
    return grouped.select(F.col("member").alias("bit"))


def bitpos(df: DataFrame, on: int, start: int = 0, end: int | None = None, buckets: int | None = None) -> DataFrame:
    """First set (or clear) bit per key in a byte range, -1 if there is none.

    Without ``end`` an array is taken to go on with zeros.  The first clear bit
    is where the ranked set bits stop to be consecutive.
    """
    low, high, backwards = _byte_bounds(start, -1 if end is None else end)
    sizes = spans(df).select(
        "key", (low * 8).cast("long").alias("_lo"), (high * 8 + 7).cast("long").alias("_hi"), backwards.alias("_bad")
    )
    empty = F.col("_bad") | (F.col("_lo") > F.col("_hi"))
    inside = (
        df.select("key", "bit").distinct().join(sizes, "key").filter(~empty & F.col("bit").between(F.col("_lo"), F.col("_hi")))
    )
    if on:
        found = inside.groupBy("key").agg(F.min("bit").alias("_p"))
        position = F.coalesce("_p", F.lit(-1))
    else:
        ranked = with_rank(inside, ["key"], ["bit"], "_r", "_n", buckets)
        found = ranked.groupBy("key").agg(F.count_if(F.col("bit") - F.col("_lo") == F.col("_r")).alias("_p"))
        at = F.col("_lo") + F.coalesce("_p", F.lit(0))
        beyond = F.lit(-1) if end is not None else at
        position = F.when(empty, F.lit(-1)).when(at > F.col("_hi"), beyond).otherwise(at)
    return sizes.join(found, "key", "left").select("key", position.cast("long").alias("bit"))
