"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.work import store

MAX_ROUNDS = 60  # the number of rounds grows with the square of the logarithm of a component's size


def _hooked(pairs: DataFrame) -> DataFrame:
    """For each (u, v): v and the smallest of u and its neighbours.  Minima are folded in the map tasks."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v: long): the smallest node it is connected with.

    Edges may repeat, point either way and be loops; edges with a null end are ignored.  No edges give no rows.
    A node with very many neighbours is folded by partial minima and joined by an equality join that adaptive
    execution may split.
    """
    u, v = F.col("u"), F.col("v")
    now = store(
        edges.filter(u.isNotNull() & v.isNotNull() & (u != v))
        .select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .distinct(),
        "edges",
    )
    state = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        # large-star: every larger neighbour of a node moves to the node's smallest neighbour
        large = _hooked(both).filter(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        # small-star: a node and its smaller neighbours move to the smallest of them
        linked = _hooked(large.filter(u > v))
        small = linked.select(v.alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v")))
        now = store(small.filter(u > v).distinct(), "edges")
        # xor of hashes: tells whether the edge set has changed, in one row
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == (seen["n"], seen["x"]):
            break
        state = (seen["n"], seen["x"])
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    roots = now.select(v.alias("node"), v.alias("component")).distinct()
    return now.select(u.alias("node"), v.alias("component")).unionByName(roots)
