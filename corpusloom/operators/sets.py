"""Keyed sets ``(key, member)``: algebra, changes, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.crawl import random_order
from corpusloom.operators.ranking import top_per_key, with_rank

WORD_BITS = 62


def _presence(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[Column], list[int]]:
    """Members with bit words that tell which of ``keys`` hold them.

    One aggregate for any number of sets: each map task folds a member to one
    row, and a set that holds most rows is not a group of its own.
    """
    keys = list(dict.fromkeys(keys))
    words, full = [], []
    for at in range(0, len(keys), WORD_BITS):
        chunk = keys[at : at + WORD_BITS]
        bit = F.lit(0).cast("long")
        for i, key in enumerate(chunk):
            bit = F.when(F.col("key") == key, F.lit(1 << i).cast("long")).otherwise(bit)
        words.append(F.bit_or(bit).alias(f"_w{len(words)}"))
        full.append((1 << len(chunk)) - 1)
    grouped = df.filter(F.col("key").isin(keys)).groupBy("member").agg(*words)
    return grouped, [F.col(f"_w{i}") for i in range(len(words))], full


def sinter(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members of all the sets; empty if one of them is absent."""
    grouped, words, full = _presence(df, keys)
    for word, mask in zip(words, full):
        grouped = grouped.filter(word == mask)
    return grouped.select("member")


def sunion(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.filter(F.col("key").isin(list(keys))).select("member").distinct()


def sdiff(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members of the first set and of none of the others."""
    first, others = keys[0], list(keys[1:])
    if first in others:
        return df.select("member").limit(0)
    grouped, words, _ = _presence(df, keys)
    for i, word in enumerate(words):
        grouped = grouped.filter(word == (1 if i == 0 else 0))
    return grouped.select("member")


def store(df: DataFrame, target: str, members: DataFrame) -> DataFrame:
    """Replace the set ``target`` by the given members."""
    kept = df.filter(F.col("key") != target).select("key", "member")
    return kept.unionByName(members.select(F.lit(target).alias("key"), "member"))


def sadd(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.select("key", "member").unionByName(rows.select("key", "member")).distinct()


def srem(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.join(rows.select("key", "member"), ["key", "member"], "left_anti")


def smove(df: DataFrame, source: str, target: str, member) -> DataFrame:
    """Move one member between sets; nothing changes if the source lacks it."""
    hit = (F.col("key") == source) & (F.col("member") == member)
    moved = df.withColumn("key", F.when(hit, F.lit(target)).otherwise(F.col("key")))
    return moved.distinct()


def is_member(df: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(key, member)`` with a 0/1 column ``found``."""
    there = df.select("key", "member").distinct().withColumn("_there", F.lit(1))
    return asked.join(there, ["key", "member"], "left").select(
        *asked.columns, F.coalesce("_there", F.lit(0)).cast("long").alias("found")
    )


def scard(df: DataFrame) -> DataFrame:
    return df.groupBy("key").agg(F.count_distinct("member").alias("size"))


def sample(df: DataFrame, n: int, replace: bool = False, seed: int = 0, buckets: int | None = None) -> DataFrame:
    """``n`` members per key: distinct ones, or ``n`` draws with replacement.

    The order is a fixed hash of member and seed.  Draws pick a position by
    hash, so they join the ranked members on (key, position), which is even.
    """
    ordered = df.select("key", "member").distinct().withColumn("_h", random_order(F.col("member"), seed))
    if not replace:
        return top_per_key(ordered, ["key"], [F.col("_h"), F.col("member")], n).drop("_h")
    ranked = with_rank(ordered, ["key"], ["_h", "member"], "_pos", "_size", buckets)
    sizes = ordered.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    token = random_order(F.concat_ws("|", "key", "draw"), seed)
    at = F.pmod(F.conv(F.substring(token, 1, 12), 16, 10).cast("long"), F.col("_n"))
    return draws.withColumn("_pos", at).join(ranked, ["key", "_pos"]).select("key", "draw", "member")


def spop(df: DataFrame, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The sampled members and the sets without them."""
    taken = sample(df, n, seed=seed)
    return taken, srem(df, taken)


def random_key(df: DataFrame, seed: int = 0) -> DataFrame:
    return df.select("key").distinct().orderBy(random_order(F.col("key"), seed), "key").limit(1)
