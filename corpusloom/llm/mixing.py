"""Sources mixed to target weights by a curriculum over training time.

Each source has a weight and a slope: its weight at time t in [0, 1] is ``weight * (1 + slope * (2 t - 1))``, whose
integral over the training is the weight.  Targets share the total size by weight; none is above ``most`` times the
source's own size, and what is cut off is shared by weight among the others until none is above.

A source's documents stand in a fixed hash order on an axis of its tokens, repeated as often as the target asks for.
The cumulative demand of a source at time t is ``target * ((1 - slope) t + slope t^2)``; a pass over a document gets
the time at which the demand reaches the document's place on the axis, and the training order is the order of times.

Sizes are summed per (source, hash range) before anything is numbered, so no source is one task's work: running sums
go inside a range, and the sums of earlier ranges are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.work import store
from corpusloom.operators.ranking import with_rank

MOST = 3
WEIGHTS = (1, 2, 3)
SLOPES = (-0.5, 0.0, 0.5)
ROWS_PER_RANGE = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` (weight > 0, source_size, further columns) with ``target``.

    The level is raised until the targets ``min(most * source_size, level * weight)`` add up to the total size.  A
    round is one aggregate row; every round but the last fixes one more source at its limit at least, most fix many.
    """
    limit = F.lit(float(most)) * F.col("source_size")
    level = 0.0
    while True:
        over = limit <= F.lit(level) * F.col("weight")
        sums = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(over, limit)).alias("fixed"),
            F.sum(F.when(~over, F.col("weight"))).alias("open"),
        ).first()
        if not sums["total"] or not sums["open"]:
            break
        raised = (sums["total"] - (sums["fixed"] or 0.0)) / sums["open"]
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return sources.withColumn("target", F.least(limit, F.lit(level) * F.col("weight")))


def default_sources(sizes: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES) -> DataFrame:
    """(source, source_size, weight, slope): weights and slopes in turn, sources by code point, null last."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull())
    ranked = with_rank(store(sources, "sources"), [], ["_null", "source"], "_rank", "_all")
    turn = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), (F.col("_rank") % len(values)).cast("int"))
    return ranked.select("source", "source_size", turn(weights).alias("weight"), turn(slopes).alias("slope"))


def _time(share: Column, slope: Column) -> Column:
    """The time at which a source's demand has reached ``share`` of its target."""
    straight = 1 - slope
    root = F.sqrt(straight * straight + 4 * slope * share)
    return F.when(F.abs(slope) < 1e-9, share).otherwise((root - straight) / (2 * slope))


def curriculum(docs: DataFrame, sources: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text), sorted by training time over range partitions.

    Columns: doc_id, source, text_hash, size, source_size, target, taken, times.  ``taken``: words the mix takes,
    repeats counted.  ``times``: the time of each pass over the document, a last pass over a part of it included; a
    document that is not taken has none and comes last.

    Taken words of a source add up to its target, rounded down; at most one document per source is taken in part.
    A null text has size 0 and is not taken.  A null source is a source of its own, the last.  Null doc_ids are ordered
    by their texts.  Equal rows are interchangeable and counted one by one.  Reruns on equal rows agree.
    """
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"),
        word_count(F.col("text").cast("string")).alias("size"),
    )
    own = own.withColumn("_hash", F.xxhash64(F.coalesce("doc_id", "text_hash"), F.lit("order")))
    sizes = store(own, "sizes")
    if sources is None:
        sources = default_sources(sizes)
    targets = store(source_targets(sources, most), "targets")

    rows = sizes.count()
    ranges = 1 << max(0, (rows // ROWS_PER_RANGE)).bit_length()
    bits = ranges.bit_length() - 1
    # the upper bits of the hash, from 0; a shift by 64 would be a shift by 0
    place = F.lit(0) if bits == 0 else F.shiftrightunsigned(F.col("_hash").bitwiseXOR(F.lit(-(2**63))), 64 - bits)
    placed = sizes.withColumn("_range", place.cast("int"))
    sums = placed.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")
    )
    inside = (
        Window.partitionBy("source", "_range")
        .orderBy(F.col("_hash"), F.col("doc_id"), F.col("text_hash"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = placed.withColumn("_inside", F.sum("size").over(inside) - F.col("size"))
    joined = running.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))).drop("_s", "_r")
    known = targets.withColumnRenamed("source", "_s")
    joined = joined.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    start = F.col("_before") + F.col("_inside")
    wanted = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = wanted - passes * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - start)).cast("long")
    taken = (passes * F.col("size") + part).alias("taken")
    count = F.when(F.col("size") == 0, F.lit(0)).otherwise(passes + F.when(part > 0, F.lit(1)).otherwise(F.lit(0)))
    share = lambda i: F.least(F.lit(1.0), (start + i * F.col("source_size")) / F.col("target"))
    every = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))
    times = F.transform(every, lambda i: _time(share(i), F.col("slope")))
    out = joined.select("doc_id", "source", "text_hash", "size", "source_size", "target", taken, times.alias("times"))
    return by_time(out.withColumn("time", F.coalesce(F.get("times", F.lit(0)), F.lit(2.0))))


def by_time(df: DataFrame) -> DataFrame:
    """Rows in training order: ranges of ``time``, sorted inside."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(partitions, "time", "doc_id").sortWithinPartitions("time", "doc_id")


def mix(docs: DataFrame, sources: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """The documents of the mix in training order, a document once per pass, with the columns of ``docs``.

    Documents stay whole: the one of a source that is taken in part is there for that pass if at least half of it is.
    """
    plan = curriculum(docs, sources, most)
    whole = F.floor(F.try_divide("taken", "size")).cast("int")
    half = 2 * (F.col("taken") - whole * F.col("size")) >= F.col("size")
    kept = F.when(F.col("size") > 0, whole + half.cast("int")).otherwise(F.lit(0))
    passes = (
        plan.select("doc_id", "source", "text_hash", F.slice("times", F.lit(1), kept).alias("times"))
        .dropDuplicates(["doc_id", "source", "text_hash"])
        .select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("text_hash").alias("_h"), "times")
    )
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    tagged = docs.select(*docs.columns, text_hash.alias("_t"))
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("_d"))
        & F.col("source").cast("string").eqNullSafe(F.col("_s"))
        & (F.col("_t") == F.col("_h"))
    )
    repeated = tagged.join(passes, same).select(*docs.columns, F.explode("times").alias("_time"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return repeated.repartitionByRange(partitions, "_time", "doc_id").sortWithinPartitions("_time", "doc_id").drop("_time")
