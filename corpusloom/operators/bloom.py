"""Bloom filters as tables: one row of eight words per block, so they grow with the keys, merge by bitwise or and are joined.

A key belongs to one block and sets one bit in each of its eight 64-bit words.  With ``KEYS_PER_BLOCK`` keys in a block
about one absent key in a thousand seems present; a present key never seems absent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
KEYS_PER_BLOCK = 24
_WORDS = [f"_w{i}" for i in range(WORDS)]


def blocks_for(keys: int) -> int:
    """Number of blocks that a filter of up to ``keys`` keys needs."""
    return max(1, -(-keys // KEYS_PER_BLOCK))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).alias("_block")


def _bits(key: Column) -> list[Column]:
    """One bit per word: six bits of a hash tell its place."""
    hashed = F.xxhash64(key, F.lit("bits"))
    places = [F.shiftright(hashed, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), p).alias(w) for p, w in zip(places, _WORDS)]


def _folded(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_block").agg(*[F.bit_or(w).alias(w) for w in _WORDS])


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter of a column's values; keys fold to blocks in the map tasks.  Null keys are not in it."""
    present = keys.filter(F.col(key).isNotNull())
    return _folded(present.select(_block(F.col(key), blocks), *_bits(F.col(key))))


def merged(*filters: DataFrame) -> DataFrame:
    """One filter of all keys of several filters with the same number of blocks."""
    return _folded(reduce(DataFrame.unionByName, filters))


def with_maybe(rows: DataFrame, key: str, bloom_filter: DataFrame, blocks: int, name: str = "_maybe") -> DataFrame:
    """Rows with a flag: false if the key is surely not in the filter.  The join carries one row per block."""
    probe = rows.select("*", _block(F.col(key), blocks), *[b.alias(f"_p{i}") for i, b in enumerate(_bits(F.col(key)))])
    met = probe.join(bloom_filter, "_block", "left")
    every = reduce(lambda a, b: a & b, [F.col(w).bitwiseAND(F.col(f"_p{i}")) != 0 for i, w in enumerate(_WORDS)])
    return met.select(*rows.columns, F.coalesce(every, F.lit(False)).alias(name))


def without_known(rows: DataFrame, known: DataFrame, key: str, bloom_filter: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key ``known`` does not hold, exactly: only keys that pass the filter are looked up in ``known``.

    The few such keys are the small side of the semi join, so a large table of known keys need not be shuffled.
    Rows with a null key stay, as in a left anti join.
    """
    flagged = with_maybe(rows, key, bloom_filter, blocks)
    asked = flagged.filter("_maybe").select(key).distinct()
    found = known.select(key).join(asked, key, "left_semi").distinct()
    # rows that are surely new do not meet the found keys: their join key is null
    own = F.when(F.col("_maybe"), F.col(key))
    out = flagged.withColumn("_asked", own).join(found.select(F.col(key).alias("_asked")), "_asked", "left_anti")
    return out.select(*rows.columns)
