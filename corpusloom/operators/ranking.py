"""Exact positions inside a key without sorting a whole key in one task.

``row_number() over (partition by key order by ...)`` puts every row of a key
into one task.  A key may hold a third of a table, so ``with_rank`` sorts the
table by (key, order) over range partitions, numbers the rows of a partition,
and adds the number of rows of the same key in earlier partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import checkpoint_root

GROUP_LIMIT = 1000  # Spark prunes row_number() <= k before the shuffle up to this k
_ROW_BITS = 33  # of monotonically_increasing_id(): the row's number in its partition


def bucket_of(point: Column, cuts: Column, size_hint: int) -> Column:
    """How many of the sorted ``cuts`` are <= the point, found by halving steps."""
    steps = F.array(*[F.lit(2**e) for e in range(size_hint.bit_length(), -1, -1)])
    size = F.size(cuts)

    def step(found: Column, jump: Column) -> Column:
        here = found + jump
        fits = (here <= size) & (F.try_element_at(cuts, here) <= point)
        return F.when(fits, here).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)


def with_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    rank: str = "rank",
    size: str = "size",
    buckets: int | None = None,
) -> DataFrame:
    """Add the zero-based ``rank`` of each row in its key and the key's ``size``.

    ``(keys, order)`` should be unique.  Order is ascending for names; a
    descending rank is ``size - 1 - rank``.  ``buckets`` is the number of range
    partitions, the session's number of shuffle partitions if absent.

    The sorted rows are checkpointed at once, so that positions and counts come
    from one and the same run of the input, repeatable or not.  What is counted
    has one row per key and range partition that it reaches into.
    """
    keys, order = list(keys), list(order)
    checkpoint_root(df.sparkSession)
    by = [*keys, *[name for name in order if isinstance(name, Column) or name not in keys]]
    ranged = df.repartitionByRange(buckets, *by) if buckets else df.repartitionByRange(*by)
    placed = ranged.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.call_function("shiftright", F.col("_at"), F.lit(_ROW_BITS)).cast("int")
    placed = placed.withColumn("_part", part)
    counts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # without keys the counts, one row per partition, are one group
    inside = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.sum("_n").over(inside.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_part").alias("_b"),
        (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(inside).alias(size),
    )
    same = F.col("_part") == F.col("_b")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return placed.join(offsets, same).select(*df.columns, (F.col("_at") + F.col("_shift")).cast("long").alias(rank), size)


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """The first ``k`` rows of each key, with the one-based ``rank`` if named.

    Up to Spark's group limit, every map task drops all but k rows per key
    before the shuffle.  A larger k may be most of a key, and is cut from ranks.
    """
    name = rank or "_rank"
    if k > GROUP_LIMIT:
        ranked = with_rank(df, keys, order, "_pos", "_size").filter(F.col("_pos") < k)
        kept = ranked.withColumn(name, (F.col("_pos") + 1).cast("int")).drop("_pos", "_size")
    else:
        ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        kept = ranked.filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def slice_bounds(start: int, stop: int, size: Column) -> tuple[Column, Column]:
    """Inclusive bounds with negatives counted from the end, clamped to the key."""
    low = F.lit(start) if start >= 0 else F.greatest(size + start, F.lit(0))
    high = F.least(F.lit(stop), size - 1) if stop >= 0 else size + stop
    return low, high


def rank_slice(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: int,
    stop: int,
    reverse: bool = False,
    rank: str = "rank",
    buckets: int | None = None,
) -> DataFrame:
    """Rows whose position lies in ``[start, stop]``; both ends included."""
    if 0 <= start <= stop < GROUP_LIMIT and buckets is None:
        by = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
        head = top_per_key(df, keys, by, stop + 1, rank="_at")
        return head.filter(F.col("_at") > start).withColumn(rank, (F.col("_at") - 1).cast("long")).drop("_at")
    ranked = with_rank(df, keys, order, rank, "_size", buckets)
    if reverse:
        ranked = ranked.withColumn(rank, F.col("_size") - 1 - F.col(rank))
    low, high = slice_bounds(start, stop, F.col("_size"))
    return ranked.filter(F.col(rank).between(low, high)).drop("_size")
