"""Approximate distinct counts: sketches of 2^14 registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG2_REGISTERS = 14


def hll_sketch(df: DataFrame, element: str, key: str = "key") -> DataFrame:
    """One sketch per key: ``(key, sketch)``.  Partial sketches are merged after the shuffle."""
    return df.groupBy(key).agg(F.hll_sketch_agg(element, LOG2_REGISTERS).alias("sketch"))


def hll_count(df: DataFrame, element: str, key: str = "key") -> DataFrame:
    return hll_sketch(df, element, key).select(key, F.hll_sketch_estimate("sketch").alias("estimate"))


def hll_merge(sketches: DataFrame, *by: str) -> DataFrame:
    """Union of sketches over all keys, or per group."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def hll_estimate(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def hll_add(sketches: DataFrame, df: DataFrame, element: str, key: str = "key") -> DataFrame:
    """Sketches with further elements, ``changed`` if a key's estimate moved."""
    more = hll_sketch(df, element, key)
    both = sketches.select(key, "sketch").unionByName(more)
    merged = both.groupBy(key).agg(F.hll_union_agg("sketch").alias("sketch"))
    old = sketches.select(key, F.hll_sketch_estimate("sketch").alias("_old"))
    moved = F.col("_old").isNull() | (F.hll_sketch_estimate("sketch") != F.col("_old"))
    return merged.join(old, key, "left").select(key, "sketch", moved.alias("changed"))
