"""Exact nearest neighbours of binary codes by multi-index hashing with growing radii (Norouzi et al., 2012).

A code of 64-bit words is cut into segments of 16 bits, and every segment has a table from value to codes.  A query
probes a segment's table at all values with exactly r flipped bits.  After radius r for the segments 0..a and r - 1 for
the others, every code at a distance of at most ``m r + a`` has been met (m segments), because a code that was not met
differs in more bits.  Radii grow segment by segment, and a query is done when its k-th verified distance is within
that bound; equal distances are complete then, so ties go to the smaller id.

A query that has k hits takes its k-th (distance, id) along, and the join lets only better codes through.

A code is verified where it is met first, that is at its least segment distance and the first such segment, so it is
never counted twice and no list of seen codes is kept.  Of equal codes only the k + 1 smallest ids are indexed, which
is all that a top-k can need of them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.work import store
from corpusloom.operators.ranking import top_per_key

SEGMENT_BITS = 16
PER_WORD = 64 // SEGMENT_BITS
TOGETHER = 2  # up to this radius all segments are probed in one step


def sign_code(vector: Column, words: int) -> Column:
    """Words of 64 sign bits, the first element in the highest bit; null, missing and non-positive elements give 0."""
    bits = F.transform(vector, lambda x: F.coalesce((x > 0).cast("long"), F.lit(0).cast("long")))
    padded = F.concat(bits, F.array_repeat(F.lit(0).cast("long"), 64 * words))

    def word(w: int) -> Column:
        return F.aggregate(F.slice(padded, 64 * w + 1, 64), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))

    return F.array(*[word(w) for w in range(words)])


def codes(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, code) of every row with an id and a vector; codes have as many words as the longest vector needs."""
    there = vectors.filter(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull())
    longest = there.agg(F.max(F.size(vector_column)).alias("n")).first()["n"] or 1
    words = max(1, -(-longest // 64))
    return there.select(F.col(id_column).cast("long").alias("id"), sign_code(F.col(vector_column), words).alias("code"))


def _segment(code: Column, j: int) -> Column:
    word = F.get(code, F.lit(j // PER_WORD))
    shift = 64 - SEGMENT_BITS * (j % PER_WORD + 1)
    return F.shiftrightunsigned(word, shift).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)).cast("int")


def _distance(a: Column, b: Column, words: int) -> Column:
    """Differing bits; one plain term per word, which stays in generated code."""
    parts = [F.bit_count(F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))) for w in range(words)]
    return sum(parts[1:], parts[0])


def _masks(radius: int) -> Column:
    values = [sum(1 << b for b in bits) for bits in combinations(range(SEGMENT_BITS), radius)]
    return F.from_json(F.lit(str(values)), "array<int>")


def _steps(segments: int):
    for radius in range(SEGMENT_BITS + 1):
        if radius <= TOGETHER:
            yield radius, list(range(segments))
        else:
            for j in range(segments):
                yield radius, [j]


def nearest(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` codes nearest to each query, itself (its id) left out.

    ``codes`` and ``queries`` have (id, code) with codes of equal length.  Rows that repeat an id and a code are one.
    Fewer than ``k`` rows come out only if there are fewer codes.  Null ids or codes must be filtered out before.
    """
    first = codes.first()
    words = len(first["code"]) if first else 1
    segments = words * PER_WORD
    kept = top_per_key(codes.distinct(), ["code"], [F.col("id")], k + 1)
    tables = F.array(*[F.struct(F.lit(j).alias("segment"), _segment(F.col("code"), j).alias("value")) for j in range(segments)])
    index = store(kept.select("id", "code", F.inline(tables)), "code-tables")
    unknown = [F.lit(None).cast("int").alias("kth"), F.lit(None).cast("long").alias("kth_id")]
    active = store(queries.distinct().select(F.col("id").alias("query_id"), F.col("code").alias("query"), *unknown), "code-queries")
    distance = _distance(F.col("query"), F.col("code"), words)
    better = F.col("kth").isNull() | (distance < F.col("kth")) | ((distance == F.col("kth")) & (F.col("id") < F.col("kth_id")))
    best = None
    results = []
    for radius, probed in _steps(segments):
        values = F.array(*[F.struct(F.lit(j).alias("segment"), _segment(F.col("query"), j).alias("_at")) for j in probed])
        probes = (
            active.select("query_id", "query", "kth", "kth_id", F.inline(values))
            .select("query_id", "query", "kth", "kth_id", "segment", "_at", F.explode(_masks(radius)).alias("_mask"))
            .select("query_id", "query", "kth", "kth_id", "segment", F.col("_at").bitwiseXOR(F.col("_mask")).alias("value"))
        )
        # met first here: no segment is nearer than this radius, and none before this one as near
        first_here = F.lit(True)
        for j in range(segments):
            apart = F.bit_count(_segment(F.col("query"), j).bitwiseXOR(_segment(F.col("code"), j)))
            first_here = first_here & (apart >= F.when(F.col("segment") > j, F.lit(radius + 1)).otherwise(F.lit(radius)))
        met = (
            # merged, as the probes are far more than the size of the queries' file tells the optimizer
            probes.join(index.filter(F.col("segment").isin(probed)).hint("merge"), ["segment", "value"])
            .filter(first_here & (F.col("id") != F.col("query_id")) & better)
            .select("query_id", "query", "id", distance.alias("distance"))
        )
        if best is not None:
            met = best.unionByName(met)
        best = store(top_per_key(met, ["query_id"], [F.col("distance"), F.col("id")], k), "code-best")
        bound = segments * radius + probed[-1]
        full = (
            best.groupBy("query_id")
            .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("distance", "id")).alias("last"))
            .filter(F.col("n") >= k)
            .select("query_id", F.col("last.distance").alias("kth"), F.col("last.id").alias("kth_id"))
        )
        done = full.filter(F.col("kth") <= bound).select("query_id")
        results.append(best.join(done, "query_id", "left_semi"))
        open_ = active.select("query_id", "query").join(full, "query_id", "left")
        active = store(open_.filter(F.col("kth").isNull() | (F.col("kth") > bound)), "code-queries")
        best = best.join(done, "query_id", "left_anti")
        if active.isEmpty():
            break
    out = best
    for more in results:
        out = out.unionByName(more)
    return top_per_key(out, ["query_id"], [F.col("distance"), F.col("id")], k, rank="rank").select("query_id", "rank", "id", "distance")
