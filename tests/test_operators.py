"""Operators on literal cases and against brute force."""

from __future__ import annotations

import io
import json
import math
import random
import re
import tarfile
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import geo as gf
from corpusloom.functions import text as tx
from corpusloom.operators import (
    bitmaps, bloom, crawl, geo, keys, lists, live_index, merge, pubsub, ranking, search, sets, sites, sketch, sorts, zsets,
)
from corpusloom.sources import files, tables


def rows(frame, *columns):
    return sorted(tuple(r) for r in (frame.select(*columns) if columns else frame).collect())


def zset(spark, **keyed):
    data = [(k, m, float(s)) for k, ms in keyed.items() for m, s in ms.items()]
    return spark.createDataFrame(data, "key string, member string, score double")


# Ranks ---------------------------------------------------------------------------


@pytest.mark.parametrize("buckets", [1, 2, 7, 50])
def test_ranks_do_not_depend_on_buckets(spark, buckets):
    """One key holds most rows and most scores are equal."""
    rng = random.Random(buckets)
    data = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", f"m{i:05}", float(rng.choice([1, 1, 1, 2, 5, -3]))) for i in range(3000)]
    data += [(None, "null-key", 1.0)]
    frame = spark.createDataFrame(data, "key string, member string, score double").repartition(6)
    ranked = ranking.with_rank(frame, ["key"], ["score", "member"], buckets=buckets)
    groups = {}
    for k, m, s in data:
        groups.setdefault(k, []).append((s, m))
    wanted = {(k, m): (i, len(g)) for k, g in groups.items() for i, (s, m) in enumerate(sorted(g))}
    got = {(r.key, r.member): (r.rank, r.size) for r in ranked.collect()}
    assert got == wanted


def test_a_hot_key_is_ranked_over_many_tasks(spark):
    frame = spark.range(40000).select(F.lit("hot").alias("key"), F.col("id").alias("pos"))
    ranked = ranking.with_rank(frame, ["key"], ["pos"], buckets=16)
    assert ranked.filter(F.col("rank") != F.col("pos")).isEmpty()
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window [row_number" not in plan
    cuts = F.array(*[F.lit(2500 * i) for i in range(1, 16)])
    sizes = frame.groupBy(ranking.bucket_of(F.col("pos"), cuts, 32).alias("b")).count().collect()
    assert {r["count"] for r in sizes} == {2500}


def test_ranks_without_keys(spark):
    frame = spark.range(500).select((F.col("id") * 37 % 501).alias("v"))
    got = rows(ranking.with_rank(frame, [], ["v"], buckets=9), "v", "rank")
    assert [r for _, r in got] == list(range(500))


def test_top_per_key_beyond_the_group_limit(spark):
    frame = spark.range(5000).select((F.col("id") % 2).alias("key"), F.col("id").alias("v"))
    got = ranking.top_per_key(frame, ["key"], [F.col("v").desc()], 1500, rank="n")
    assert got.count() == 3000 and got.agg(F.min("v")).first()[0] == 2000


# Sets ----------------------------------------------------------------------------


def numbered_sets(spark):
    s = {
        "s1": [*range(200), 200], "s2": [*range(195, 395), 200], "s3": [199, 195, 1000, 2000, 200],
        "s4": [*range(5, 200), 200], "s5": [0, 200],
    }
    return spark.createDataFrame([(k, m) for k, ms in s.items() for m in ms], "key string, member int")


def test_set_algebra_literals(spark):
    df = numbered_sets(spark)
    flat = lambda frame: [r[0] for r in rows(frame)]
    assert flat(sets.sinter(df, ["s1", "s2"])) == [195, 196, 197, 198, 199, 200]
    assert flat(sets.sinter(df, ["s1", "s2", "s3"])) == [195, 199, 200]
    assert flat(sets.sinter(df, ["s1", "none"])) == []
    assert flat(sets.sdiff(df, ["s1", "s4"])) == [0, 1, 2, 3, 4]
    assert flat(sets.sdiff(df, ["s1", "s4", "s5"])) == [1, 2, 3, 4]
    assert flat(sets.sdiff(df, ["s1", "s1"])) == []
    assert len(flat(sets.sunion(df, ["s1", "s2", "none"]))) == 395


def test_algebra_of_many_random_sets(spark):
    rng = random.Random(3)
    model = {f"k{i}": {rng.randrange(60) for _ in range(rng.randrange(40, 200))} for i in range(70)}
    df = spark.createDataFrame([(k, m) for k, ms in model.items() for m in ms], "key string, member int")
    names = list(model)
    assert {r[0] for r in sets.sinter(df, names).collect()} == set.intersection(*model.values())
    for first in names[:3]:
        others = rng.sample(names, 4)
        wanted = model[first] - set().union(*(model[o] for o in others))
        assert {r[0] for r in sets.sdiff(df, [first, *others]).collect()} == wanted


def test_set_changes(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "key string, member int")
    assert rows(sets.smove(df, "a", "b", 2)) == [("a", 1), ("b", 2)]
    assert rows(sets.smove(df, "a", "b", 9)) == rows(df)
    taken, rest = sets.spop(df, 1, seed=1)
    assert taken.count() == 2 and rows(taken.unionByName(rest)) == rows(df)
    draws = sets.sample(df, 6, replace=True, buckets=3)
    assert draws.count() == 12 and set(rows(draws, "key", "member")) <= set(rows(df))


def test_weighted_unions(spark):
    df = zset(spark, a={"a": 1, "b": 2, "c": 3}, b={"b": 1, "c": 2, "d": 3})
    union = lambda **o: rows(zsets.zcombine(df, ["a", "b"], **o))
    assert union() == [("a", 1), ("b", 3), ("c", 5), ("d", 3)]
    assert union(weights=[2, 3]) == [("a", 2), ("b", 7), ("c", 12), ("d", 9)]
    assert union(aggregate="min") == [("a", 1), ("b", 1), ("c", 2), ("d", 3)]
    assert union(aggregate="max") == [("a", 1), ("b", 2), ("c", 3), ("d", 3)]
    assert union(mode="inter") == [("b", 3), ("c", 5)]
    assert union(mode="inter", weights=[2, 3]) == [("b", 7), ("c", 12)]
    assert union(mode="inter", aggregate="min") == [("b", 1), ("c", 2)]
    assert rows(zsets.zcombine(df, ["a", "a"], [1, 10])) == [("a", 11), ("b", 22), ("c", 33)]
    assert rows(zsets.zcombine(df, ["a", "none"], mode="inter")) == []


def test_infinite_scores(spark):
    df = zset(spark, a={"x": -math.inf, "y": math.inf}, b={"y": -math.inf})
    assert rows(zsets.zcombine(df, ["a"], [0])) == [("x", 0.0), ("y", 0.0)]
    assert rows(zsets.zcombine(df, ["a", "b"])) == [("x", -math.inf), ("y", 0.0)]


def test_score_and_lex_ranges_against_brute_force(spark):
    rng = random.Random(8)
    data = {f"m{rng.randrange(10**6)}": rng.choice([rng.random(), 0.5, 0.25]) for _ in range(300)}
    df = zset(spark, k=data)
    order = sorted((s, m) for m, s in data.items())
    for start, stop in [(0, 5), (-7, -3), (10, -10), (290, 400), (5, 3), (-400, 2)]:
        wanted = order[slice(start if start >= 0 else max(len(order) + start, 0), None)]
        last = stop if stop >= 0 else len(order) + stop
        wanted = [x for i, x in enumerate(order) if x in wanted and i <= last]
        for buckets in (None, 5):
            assert rows(zsets.zrange(df, start, stop, buckets=buckets), "score", "member") == wanted
    low, high = 0.25, 0.5
    got = rows(zsets.zrange_by_score(df, low, high, low_open=True), "score", "member")
    assert got == [x for x in order if low < x[0] <= high]
    page = rows(zsets.zrange_by_score(df, low, high, offset=3, count=4, reverse=True), "score", "member")
    assert page == sorted([x for x in reversed(order) if low <= x[0] <= high][3:7])
    names = sorted(data)
    got = [m for (m,) in rows(zsets.zrange_by_lex(df, f"({names[10]}", f"[{names[50]}"), "member")]
    assert got == names[11:51]
    kept = rows(zsets.zrem_range_by_rank(df, 2, -3, buckets=4), "score", "member")
    assert kept == order[:2] + order[-2:]


def test_zadd_modes(spark):
    df = zset(spark, k={"a": 1, "b": 2})
    changes = spark.createDataFrame([("k", "a", 5.0, 1), ("k", "a", 6.0, 2), ("k", "c", 7.0, 3)], "key string, member string, score double, seq int")
    assert rows(zsets.zadd(df, changes), "member", "score") == [("a", 6), ("b", 2), ("c", 7)]
    assert rows(zsets.zadd(df, changes, "nx"), "member", "score") == [("a", 1), ("b", 2), ("c", 7)]
    assert rows(zsets.zadd(df, changes, "xx"), "member", "score") == [("a", 6), ("b", 2)]
    assert rows(zsets.zadd(df, changes, "incr"), "member", "score") == [("a", 12), ("b", 2), ("c", 7)]
    assert rows(zsets.zadd_changed(df, changes)) == [("k", 1, 1)]


# Lists ---------------------------------------------------------------------------


def test_list_operators_against_a_model(spark):
    rng = random.Random(2)
    model = {f"k{i}": [rng.choice("abc") for _ in range(rng.randrange(1, 30))] for i in range(6)}
    df = spark.createDataFrame([(k, p * 3 - 10, v) for k, vs in model.items() for p, v in enumerate(vs)], "key string, pos long, value string")

    def read(frame):
        out = {}
        for r in frame.orderBy("key", "pos").collect():
            out.setdefault(r.key, []).append(r.value)
        return out

    keep = lambda made: {k: v for k, v in made.items() if v}
    for buckets in (None, 4):
        assert read(lists.ltrim(df, 1, -2, buckets)) == keep({k: v[1:-1] for k, v in model.items()})
        assert read(lists.lindex(df, -1, buckets)) == {k: v[-1:] for k, v in model.items()}
        pushed = spark.createDataFrame([("k1", "x", 1), ("k1", "y", 2), ("new", "z", 3)], "key string, value string, seq int")
        left = read(lists.push(df, pushed, "left", buckets=buckets))
        assert left["k1"] == ["y", "x", *model["k1"]] and left["new"] == ["z"]
        right = read(lists.push(df, pushed, "right", only_existing=True, buckets=buckets))
        assert right["k1"] == [*model["k1"], "x", "y"] and "new" not in right

        def without(values, n):
            values = list(values) if n >= 0 else list(values)[::-1]
            for _ in range(abs(n)):
                if "a" in values:
                    values.remove("a")
            return values if n >= 0 else values[::-1]

        assert read(lists.lrem(df, "a", 2, buckets)) == keep({k: without(v, 2) for k, v in model.items()})
        assert read(lists.lrem(df, "a", -1, buckets)) == keep({k: without(v, -1) for k, v in model.items()})
    assert read(lists.lrem(df, "a")) == keep({k: [x for x in v if x != "a"] for k, v in model.items()})

    def inserted(values, before):
        if "b" not in values:
            return values
        at = values.index("b") + (0 if before else 1)
        return [*values[:at], "NEW", *values[at:]]

    for before in (True, False):
        assert read(lists.linsert(df, "b", "NEW", before)) == {k: inserted(v, before) for k, v in model.items()}
    assert read(lists.lset(df, 0, F.lit("Z"))) == {k: ["Z", *v[1:]] for k, v in model.items()}
    moved = read(lists.rotate(df, "k0", "k1"))
    assert moved["k1"] == [model["k0"][-1], *model["k1"]] and moved.get("k0", []) == model["k0"][:-1]
    same = read(lists.rotate(df, "k2", "k2"))
    assert same["k2"] == [model["k2"][-1], *model["k2"][:-1]]
    assert [p for _, p, _ in rows(lists.renumber(df.filter("key = 'k3'")))] == list(range(len(model["k3"])))


# Merges and keys -----------------------------------------------------------------


def test_merges(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, x string, y int")
    changes = spark.createDataFrame([(2, "c", None, 1), (2, None, 5, 2), (3, "d", 7, 1)], "id int, x string, y int, seq int")
    assert sorted(rows(merge.upsert(base, changes, ["id"], "seq")), key=str) == [(1, "a", 10), (2, None, 5), (3, "d", 7)]
    assert rows(merge.partial_update(base, changes, ["id"], "seq")) == [(1, "a", 10), (2, "c", 5)]
    assert rows(merge.insert_absent(base, changes, ["id"], "seq")) == [(1, "a", 10), (2, "b", 20), (3, "d", 7)]
    assert rows(merge.absent_keys(base, changes, ["id"])) == [(3,)]
    assert rows(merge.insert_all_or_none(base, changes, ["id"], "seq")) == rows(base)
    assert len(rows(merge.insert_all_or_none(base, changes.filter("id = 3"), ["id"], "seq"))) == 3


def test_counter_errors(spark):
    big = spark.createDataFrame([("a", 2**62), ("a", 2**62)], "key string, delta long")
    with pytest.raises(Exception, match="overflow"):
        merge.counters(big, ["key"]).collect()
    nan = spark.createDataFrame([("a", math.inf)], "key string, delta double")
    with pytest.raises(Exception, match="NaN or infinite"):
        merge.counters(nan, ["key"]).collect()


def test_rename(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, value int")
    assert rows(merge.rename_key(df, "a", "b")) == [("b", 1), ("c", 3)]
    assert rows(merge.rename_key(df, "a", "b", only_new=True)) == rows(df)
    assert rows(merge.rename_key(df, "a", "d", only_new=True)) == [("b", 2), ("c", 3), ("d", 1)]
    assert rows(merge.rename_key(df, "x", "b")) == rows(df)


def test_append_is_checked_for_size(spark):
    base = spark.createDataFrame([("a", "x")], "key string, value string")
    chunks = spark.createDataFrame([("a", "z", 2), ("a", "y", 1), ("b", "q", 1)], "key string, value string, seq int")
    assert rows(keys.append_rows(base, chunks)) == [("a", "xyz"), ("b", "q")]
    with pytest.raises(Exception, match="maximum size"):
        keys.append_rows(base, chunks, limit=2).collect()


# Bits ----------------------------------------------------------------------------


def bits_of(spark, **arrays):
    data = [(k, i) for k, b in arrays.items() for i in range(len(b) * 8) if b[i // 8] >> (7 - i % 8) & 1]
    return spark.createDataFrame(data, "key string, bit long")


def test_bit_operators(spark):
    a, b = b"\xff\x00\x0f\x01", b"\x0f\xf0\x01"
    df = bits_of(spark, a=a, b=b)
    assert rows(bitmaps.bitcount(df.unionByName(df))) == [("a", 13), ("b", 9)]
    assert rows(bitmaps.bitcount(df, 1, -2)) == [("a", 4), ("b", 4)]
    assert rows(bitmaps.bitcount(df, -6, -7)) == [("a", 0), ("b", 0)]
    assert rows(bitmaps.bitcount(df, 100, 200)) == [("a", 0), ("b", 0)]
    number = lambda frame, n: sum(1 << (8 * n - 1 - r[0]) for r in frame.collect()).to_bytes(n, "big")
    assert number(bitmaps.bitop(df, "and", ["a", "b"]), 4) == b"\x0f\x00\x01\x00"
    assert number(bitmaps.bitop(df, "or", ["a", "b"]), 4) == b"\xff\xf0\x0f\x01"
    assert number(bitmaps.bitop(df, "xor", ["a", "b"]), 4) == b"\xf0\xf0\x0e\x01"
    assert number(bitmaps.bitop(df, "not", ["a"]), 4) == b"\x00\xff\xf0\xfe"


def test_bit_positions(spark):
    df = bits_of(spark, a=b"\xff\xf0\x01", b=b"\x00\x01", c=b"\xff\xff")
    for buckets in (None, 3):
        assert rows(bitmaps.bitpos(df, 1, buckets=buckets)) == [("a", 0), ("b", 15), ("c", 0)]
        assert rows(bitmaps.bitpos(df, 0, buckets=buckets)) == [("a", 12), ("b", 0), ("c", 16)]
        assert rows(bitmaps.bitpos(df, 0, 0, 0, buckets=buckets)) == [("a", -1), ("b", 0), ("c", -1)]
        assert rows(bitmaps.bitpos(df, 1, 2, buckets=buckets)) == [("a", 23), ("b", -1), ("c", -1)]


# Sketch, geo, sort, messages -------------------------------------------------------


def test_sketch_unions(spark):
    df = spark.createDataFrame([("1", x) for x in "abc"] + [("2", x) for x in "bcd"] + [("3", x) for x in "cde"], "key string, e string")
    union = sketch.hll_merge(sketch.hll_sketch(df, "e"))
    assert union.select(sketch.hll_estimate(F.col("sketch"))).first()[0] == 5
    many = spark.range(30000).select(F.lit("k").alias("key"), (F.col("id") % 29997).cast("string").alias("e"))
    assert abs(sketch.hll_count(many, "e").first().estimate - 29997) < 29997 * 0.05
    again = sketch.hll_add(sketch.hll_sketch(df, "e"), df.withColumn("e", F.when(F.col("key") == "1", "new").otherwise(F.col("e"))), "e")
    assert rows(again, "key", "changed") == [("1", True), ("2", False), ("3", False)]


@pytest.mark.parametrize("radius", [10.0, 40_000.0, 900_000.0, 6_000_000.0, 19_000_000.0])
def test_radius_against_brute_force(spark, radius):
    rng = random.Random(int(radius))
    places = [(i, rng.uniform(-180, 180), rng.uniform(-85, 85)) for i in range(400)]
    places += [(400 + i, rng.choice([179.99, -179.99, 180.0, -180.0]), rng.choice([-85.0, 0.0, 85.0, 84.99])) for i in range(40)]
    places += [(440 + i, 2.0 + rng.uniform(-1e-4, 1e-4), 48.0 + rng.uniform(-1e-4, 1e-4)) for i in range(40)]
    points = spark.createDataFrame(places, "member int, lon double, lat double")
    spots = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(12)] + [(12, 180.0, 85.0), (13, -180.0, -90.0), (14, 2.0, 48.0), (15, 0.0, 90.0)]
    centers = spark.createDataFrame(spots, "center int, lon double, lat double")

    def far(a, b):
        u, v = math.sin(math.radians(b[2] - a[2]) / 2), math.sin(math.radians(b[1] - a[1]) / 2)
        return 2 * gf.EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, u * u + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * v * v)))

    wanted = {(c[0], p[0]) for c in spots for p in places if far(c, p) <= radius}
    edge = {(c[0], p[0]) for c in spots for p in places if abs(far(c, p) - radius) < 1e-3}
    found = [tuple(r) for r in geo.geo_radius(points, centers, radius).select("center", "member").collect()]
    assert len(found) == len(set(found))
    assert set(found) ^ wanted <= edge


def great_circle(lon1, lat1, lon2, lat2):
    """Spherical law of cosines, another formula than the library's."""
    a, b = math.radians(lat1), math.radians(lat2)
    return gf.EARTH_RADIUS_M * math.acos(min(1.0, math.sin(a) * math.sin(b) + math.cos(a) * math.cos(b) * math.cos(math.radians(lon2 - lon1))))


def test_radius_of_named_points(spark):
    """Places on a made-up island; expected distances are computed here."""
    rng = random.Random(5)
    places = {name: (30.0 + rng.random() / 10, -12.0 + rng.random() / 10) for name in ("harbour", "mill", "ford", "beacon", "quarry", "well")}
    data = [(name, *at) for name, at in places.items()]
    points = spark.createDataFrame(data, "member string, lon double, lat double")
    center = spark.createDataFrame([("c", 30.05, -11.95)], "center string, lon double, lat double")
    expected = sorted((great_circle(30.05, -11.95, *at), name) for name, at in places.items())
    radius = (expected[3][0] + expected[4][0]) / 2
    near = geo.geo_radius(points, center, radius, order="asc", unit="km").collect()
    assert [r.member for r in near] == [name for _, name in expected[:4]]
    assert [r.dist for r in near] == pytest.approx([m / 1000 for m, _ in expected[:4]], abs=1e-5)
    nearest = geo.geo_nearest(points, center, 2, radius).collect()
    assert sorted(r.member for r in nearest) == sorted(name for _, name in expected[:2])


def test_nearest_points_in_growing_circles(spark):
    """Most points lie in one town, some centers far off have fewer than k points in reach."""
    rng = random.Random(9)
    data = [(f"t{i}", 5 + rng.gauss(0, 0.02), 50 + rng.gauss(0, 0.02)) for i in range(3000)] + [(f"f{i}", rng.uniform(-180, 180), rng.uniform(-85, 85)) for i in range(200)]
    centers = [("town", 5.0, 50.0), ("date line", 179.9, 3.0), ("pole", 0.0, 84.0)] + [(f"c{i}", rng.uniform(-180, 180), rng.uniform(-80, 80)) for i in range(12)]
    got = geo.geo_nearest(
        spark.createDataFrame(data, "member string, lon double, lat double"), spark.createDataFrame(centers, "center string, lon double, lat double"), 7, 2_000_000.0
    ).collect()
    for name, lon, lat in centers:
        near = sorted((great_circle(lon, lat, x, y), m) for m, x, y in data)
        expected = {m for d, m in near[:7] if d <= 2_000_000.0}
        assert {r.member for r in got if r.center == name} == expected


def test_hot_keys_are_salted(spark, monkeypatch):
    from corpusloom.operators import joins

    monkeypatch.setattr(joins, "LEAST_HOT", 50)
    large = spark.range(2000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"), "id")
    large = large.unionByName(spark.createDataFrame([(None, -1)], "key string, id long"))
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), (None, 4)], "key string, v int")
    found = joins.hot_keys(large, ["key"], 4)
    assert len(found) == 1 and max(found.values()) >= 2
    assert rows(joins.salted_join(large, small, ["key"], ["id"])) == rows(large.join(small, "key"))
    left = joins.salted_join(large, small, ["key"], ["id"], "left")
    assert left.count() == large.join(small, "key", "left").count() and left.filter("id = -1").first().v is None


def test_sorts(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "item string")
    weights = spark.createDataFrame([("a", "1"), ("b", "5"), ("c", "2"), ("d", "10"), ("e", "3")], "item string, weight string")
    order = lambda **o: [r.item for r in sorts.sort_by(items, weights, **o).collect()]
    assert order() == list("acebd")
    assert order(desc=True, count=2) == ["d", "b"]
    assert order(alpha=True) == list("adceb")
    some = weights.filter("item <> 'c'")
    assert [r.item for r in sorts.sort_by(items, some, alpha=True).collect()][0] == "c"
    assert [r.item for r in sorts.sort_by(items, some).collect()][0] == "c"
    got = sorts.sort_by(items, weights, {"w": weights.withColumnRenamed("weight", "value")}, offset=1, count=2).collect()
    assert [(r.item, r.w) for r in got] == [("c", "2"), ("e", "3")]


def test_routing(spark):
    subs = spark.createDataFrame(
        [("s1", "news.art", None), ("s2", None, "news.*"), ("s3", None, "*"), ("s4", None, "news.[^a]*"), ("s2", "news.art", None)],
        "subscriber string, channel string, pattern string",
    )
    messages = spark.createDataFrame([("news.art", 1), ("news.sport", 2), ("x", 3)], "channel string, payload int")
    got = rows(pubsub.route(messages, subs), "payload", "subscriber", F.coalesce("pattern", F.lit("-")))
    assert got == [
        (1, "s1", "-"), (1, "s2", "-"), (1, "s2", "news.*"), (1, "s3", "*"), (2, "s2", "news.*"), (2, "s3", "*"), (2, "s4", "news.[^a]*"), (3, "s3", "*"),
    ]
    assert pubsub.unsubscribe(subs, subs.filter("channel is not null")).count() == 3


# Search, crawl, sources --------------------------------------------------------------


def test_percolation_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choices(words, k=8)) + " common") for i in range(60)]
    asked = [(i, " ".join(rng.sample(words + ["common"], rng.randrange(1, 4)))) for i in range(40)] + [(99, "the of"), (98, "absent common")]
    made = search.percolate(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(asked, "qid int, query string"))
    wanted = [(d, q) for d, t in docs for q, w in asked if w != "the of" and set(w.split()) <= set(t.split())]
    assert rows(made) == sorted(wanted)


def test_ranked_search_forms_agree(spark, tmp_path):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat cat bird"), (3, "fish"), (4, ""), (5, None)], "_id int, text string")
    lazy = rows(search.search(search.build_index(docs, ["text"]), "cat bird"), "_id", "score")
    search.write_index(docs, ["text"], str(tmp_path / "i"), partitions=3)
    assert rows(search.search(search.read_index(spark, str(tmp_path / "i")), "cat bird"), "_id", "score") == lazy
    assert rows(search.scan_search(docs, "_id", "text", "cat bird"), "_id", "score") == lazy
    assert [i for i, _ in lazy] == [1, 2]
    assert search.scan_search(docs, "_id", "text", "the").count() == 0


def test_crawl_follows_links_and_stops(spark):
    page = lambda *links: "".join(f'<a href="{x}">x</a>' for x in links)
    pages = [
        ("http://a.com/", page("/1", "http://b.com/", "/#top")), ("http://a.com/1", page("2?x=1&y=2", "/")),
        ("http://a.com/2?y=2&x=1", page("/3")), ("http://a.com/3#f", page("/1", "/4")), ("http://b.com/", page("/9")),
    ]
    table = spark.createDataFrame(pages, "url string, html string")
    seeds = spark.createDataFrame([("http://a.com/",), ("http://a.com/#again",)], "url string")
    items, seen = crawl.crawl(seeds, table)
    assert rows(items, "depth", "url") == [(0, "http://a.com/"), (1, "http://a.com/1"), (2, "http://a.com/2?y=2&x=1"), (3, "http://a.com/3#f")]
    assert rows(seen, "depth", "url")[-1] == (4, "http://a.com/4")
    _, two = crawl.crawl(seeds, table, max_rounds=1)
    assert two.count() == 2
    _, none = crawl.crawl(seeds, table, domains="b.com")
    assert none.count() == 0


def test_texts_of_one_url_and_bloom_filter(spark):
    """The lowest text of a url counts; the filter misses no key, passes few others and merges."""
    page = "<html><head><title>{}</title></head><body>x</body></html>"
    pages = spark.createDataFrame([("http://a.com/", page.format(t)) for t in "cab"] + [("http://a.com/n", None)], "url string, html string")
    items, _ = crawl.crawl(pages.select("url").distinct(), pages)
    assert rows(items, "url", "title")[0] == ("http://a.com/", "a") and items.count() == 2
    keys = spark.range(6000).select(F.sha1(F.col("id").cast("string")).alias("fp"))
    blocks = bloom.blocks_for(3000)
    first = bloom.merged(bloom.bloom(keys.limit(0), "fp", blocks), *[bloom.bloom(spark.range(a, a + 1500).select(F.sha1(F.col("id").cast("string")).alias("fp")), "fp", blocks) for a in (0, 1500)])
    flags = bloom.with_maybe(keys.withColumn("n", F.lit(1)), "fp", first, blocks).groupBy("_maybe").count().collect()
    passed = {r["_maybe"]: r["count"] for r in flags}[True]
    assert 3000 <= passed <= 3030
    known = spark.range(3000).select(F.sha1(F.col("id").cast("string")).alias("fp"))
    odd = keys.unionByName(spark.createDataFrame([(None,)], "fp string"))
    new = bloom.without_known(odd, known, "fp", first, blocks)
    assert new.count() == 3001 and new.join(known, "fp", "left_semi").count() == 0


def test_site_codes_are_stable(spark):
    known = spark.createDataFrame([("a.com", 7)], "site string, site_code long")
    seen = spark.createDataFrame([("c.com", 5), ("b.com", 5), ("a.com", 1), ("d.com", 2)], "site string, first_seen int")
    for buckets in (None, 3):
        assert rows(sites.assign_site_codes(seen, known, buckets=buckets)) == [("a.com", 7), ("b.com", 9), ("c.com", 10), ("d.com", 8)]


def test_json_lines_and_archives(spark, tmp_path):
    lines = [json.dumps({"url": f"http://a.com/{i}", "title": f"t{i}"}) for i in range(5)] + ["{broken", ""]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "in" / "b.txt").write_text(lines[0])
    read = files.read_jsonl(spark, str(tmp_path / "in"), "zh")
    assert files.good_rows(read).filter("origin = 'zh'").count() == 5
    assert [r.line for r in files.bad_lines(read).collect()] == ["{broken"]
    with tarfile.open(tmp_path / "in" / "c.jsonl.tgz", "w:gz") as archive:
        for name in ("x/one.jsonl", "x/two.json"):
            data = "\n".join(lines).encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    packed = files.read_jsonl_archives(spark, str(tmp_path / "in"), "en", spread=2)
    assert rows(files.good_rows(packed), "title", "origin") == [(f"t{i}", "en") for i in range(5)]


def test_archives_as_a_stream(spark, tmp_path):
    """Archives that arrive later are read once; members of many lines pass in pieces; an empty folder gives no rows."""
    def put(name, lines):
        with tarfile.open(tmp_path / "in" / name, "w:gz") as archive:
            data = "\n".join(lines).encode()
            info = tarfile.TarInfo("x.jsonl")
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))

    (tmp_path / "in").mkdir()
    def drain():
        rows = files.good_rows(files.stream_jsonl_archives(spark, str(tmp_path / "in"), files_per_batch=1)).select("title", "origin")
        job = rows.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        job.format("parquet").start(str(tmp_path / "out")).awaitTermination()
        return spark.read.schema(rows.schema).parquet(str(tmp_path / "out"))

    put("a b.jsonl.tgz", [f'{{"title": "é{i}"}}' for i in range(4500)])
    assert drain().count() == 4500
    put("b.jsonl.tgz", ['{"title": "late"}', "", "broken"])
    put("empty.jsonl.tgz", [])
    got = drain()
    assert got.count() == 4501 and {r.origin for r in got.collect()} == {"en"}
    assert got.filter("title in ('late', 'é4499')").count() == 2


def test_html_tree_pipe_text_and_queue(spark, tmp_path):
    deep = tmp_path / "tree" / "a" / "b"
    deep.mkdir(parents=True)
    (deep / "x.html").write_text("<title>X</title>\n<p>one")
    (deep / "y.htm").write_text("<title>Y</title>")
    (deep / "z.txt").write_text("<title>Z</title>")
    docs = files.with_document_id(files.read_html_tree(spark, str(tmp_path / "tree")), "http://unknown.example/")
    assert [t for t, in rows(docs, "title")] == ["X", "Y"]
    assert {r.url for r in docs.select("url").collect()} == {"http://unknown.example/"}
    (tmp_path / "p.txt").write_text('id | name\n1 | "a\n2 | b c\n')
    assert rows(files.read_pipe_text(spark, str(tmp_path / "p.txt"))) == [("1", '"a'), ("2", "b c")]
    queue = spark.createDataFrame([(3,), (5,)], "v int")
    files.dump_values(queue, "v", str(tmp_path / "q"))
    assert rows(files.load_values(spark, str(tmp_path / "q"), "int")) == [(3,), (5,)]


def test_tables_and_aliases(spark, tmp_path):
    from corpusloom.schemas import DOC_PLAIN

    tables.create_index(spark, "plain01", DOC_PLAIN, str(tmp_path / "t"))
    assert spark.table("plain01").columns[-1] == "site_code" and tables.scan_all(spark, "plain01").count() == 0
    tables.delete_index(spark, "plain01")
    first = tables.publish(spark.range(3), "numbers", str(tmp_path))
    tables.publish(spark.range(5), "numbers", str(tmp_path))
    assert tables.scan_all(spark, "numbers", F.col("id") > 1).count() == 3
    tables.alias(spark, "numbers", first)
    assert spark.table("numbers").count() == 3


def test_rank_of_an_input_that_does_not_repeat(spark):
    frame = spark.range(3000).select(F.lit("k").alias("key"), F.rand().alias("v"), F.col("id"))
    got = ranking.with_rank(frame, ["key"], ["v", "id"], buckets=7).collect()
    assert sorted(r["rank"] for r in got) == list(range(3000)) and {r["size"] for r in got} == {3000}
    by_rank = sorted(got, key=lambda r: r["rank"])
    assert [(r.v, r.id) for r in by_rank] == sorted((r.v, r.id) for r in got)


def test_dictionary_of_many_words(spark):
    signs = [chr(0x4E00 + i) for i in range(600)]
    words = [(a + b,) for a in signs[:450] for b in signs[:450]][:200_000] + [(signs[500] + signs[0] + signs[1],)]
    docs = spark.createDataFrame([(1, signs[0] + signs[1] + signs[550] + "ab c" + signs[500] + signs[0] + signs[1]), (2, None), (3, "")], "id long, t string")
    got = {r.id: r.terms for r in search.dictionary_terms(docs, "id", "t", spark.createDataFrame(words, "word string")).collect()}
    assert got == {1: [signs[0] + signs[1], signs[550], "ab", "c", signs[500] + signs[0] + signs[1]], 2: [], 3: []}


@pytest.mark.parametrize("limit", [8_000_000, 0])
def test_dictionary_rows_keep_their_ids(spark, monkeypatch, limit):
    """Null and repeated ids; the automaton and the join give the same terms."""
    monkeypatch.setattr(search, "AUTOMATON_CHARS", limit)
    docs = spark.createDataFrame([(None, "abcd ef"), (1, "aab"), (1, "zz ab"), (2, None)], "id long, t string")
    words = spark.createDataFrame([("ab",), ("abc",), ("a",), (None,), ("",)], "word string")
    stop = spark.createDataFrame([("ef",), ("a",)], "word string")
    got = sorted(((r.id, r.terms) for r in search.dictionary_terms(docs, "id", "t", words, stop).collect()), key=str)
    assert got == [(1, ["ab"]), (1, ["zz", "ab"]), (2, []), (None, ["abc", "d"])]


def test_sites_by_rules(spark):
    rules = spark.createDataFrame([("com",), ("com.bd",), ("*.ck",), ("!www.ck",), ("jp",), ("*.kobe.jp",), (None,)], "suffix string")
    hosts = {"www.shop.com.bd": "shop.com.bd", "a.b.com": "b.com", "x.y.z.ck": "y.z.ck", "a.www.ck": "www.ck", "p.q.r.kobe.jp": "q.r.kobe.jp", "a.b.zz": "b.zz", "com": "com", "10.0.0.1": "10.0.0.1"}
    frame = spark.createDataFrame([(f"http://{h}/p",) for h in hosts] * 2, "url string")
    got = sites.site_by_rules(frame, rules).collect()
    assert len(got) == 16 and all(r.site == hosts[r.url[7:-2]] for r in got)


def test_sort_with_offset_alone(spark):
    items = spark.createDataFrame([(str(i), ) for i in range(50)], "item string")
    got = [r.item for r in sorts.sort_by(items, offset=45, desc=True).collect()]
    assert got == ["4", "3", "2", "1", "0"]


def test_index_parts_are_merged(spark, tmp_path):
    """Upserts and deletions by turns; the merged index equals one made at once, parts stay few, old versions readable."""
    path = str(tmp_path / "parts")
    docs = spark.range(64).select(F.concat(F.lit("d"), "id").alias("_id"), F.concat(F.lit("word"), F.col("id") % 7, F.lit(" all")).alias("text"))
    for at in range(4):
        put = docs.filter(F.substring("_id", 2, 9).cast("int") % 4 == at)
        live_index.change(spark, path, put, ["text"], put.filter("_id < 'd2'") if at % 3 == 2 else None)
        size = 64
        assert len(live_index.parts(spark, path)) <= 1 + math.log2(size)
    live_index.change(spark, path, docs.filter("_id = 'd3'").withColumn("text", F.lit("other")), ["text"])
    live_index.change(spark, path, deletes=docs.filter("_id in ('d4', 'd5')"))
    final = docs.filter("_id not in ('d3', 'd4', 'd5')").unionByName(spark.createDataFrame([("d3", "other")], "_id string, text string"))
    once = str(tmp_path / "once")
    live_index.change(spark, once, final, ["text"])
    view = lambda p, v=None: rows(live_index.live_postings(spark, p, v), "_id", "term", "tf", "length")
    assert view(path) == view(once)
    a, b = live_index.read_index(spark, path), live_index.read_index(spark, once)
    assert rows(a.freq, "field", "term", "df") == rows(b.freq, "field", "term", "df") and rows(a.stats) == rows(b.stats)
    assert len(view(path, 1)) == 16
    assert live_index.vacuum(spark, path, keep=1) and view(path) == view(once)


def test_snippets_from_offsets(spark, tmp_path):
    path = str(tmp_path / "cover")
    text = "heart " + "filler " * 12 + "attack of the heart, heart attack" + " end" * 30
    docs = spark.createDataFrame([("a", text), ("b", "nothing"), ("c", "only the heart")], "_id string, text string")
    live_index.change(spark, path, docs, ["text"])
    got = {r._id: r for r in live_index.snippets(live_index.live_postings(spark, path), docs, "heart attack", "text", 30).collect()}
    assert set(got) == {"a", "c"} and got["c"].snippet == "only the heart"[got["c"].start :].replace("heart", "<em>heart</em>")
    assert got["a"].start == text.index("heart attack") and got["a"].terms == 2
    assert got["a"].snippet == "<em>heart</em> <em>attack</em>" + (" end" * 30)[:18]


def test_many_searches_with_bounds(spark, monkeypatch):
    """Every query against a plain sum of weights: ties, offsets, fields, more documents than a block, queries without hits."""
    from corpusloom.operators import multisearch

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    data = [(i, " ".join(rng.choices(vocabulary, range(40, 0, -1), k=rng.randint(1, 12))), rng.choice(vocabulary)) for i in range(500)] + [(500, "w1 w2", "w1"), (501, "w1 w2", "w1")]
    docs = spark.createDataFrame(data, "_id long, text string, title string")
    index = search.build_index(docs, ["text", "title"])
    asked = [(q, " ".join(rng.sample(vocabulary, rng.randint(1, 6))), rng.choice([None, 3, 60]), rng.choice([None, 2]), rng.choice([None, ["text"], ["title"]])) for q in range(25)]
    asked += [(97, "absent", None, None, None), (98, None, None, None, None), (99, "w1", 5, 0, [])]
    queries = spark.createDataFrame(asked, "qid int, query string, size int, offset int, fields array<string>")
    got = {}
    for r in multisearch.msearch(index, queries, k=8).collect():
        got.setdefault(r.qid, []).append((r["rank"], r._id, r.score))
    for qid, text, size, offset, fields in asked:
        boosts = None if fields is None else fields
        expected = [] if boosts == [] or not text else search.search(index, text, size or 8, offset or 0, fields=boosts).collect()
        assert [(i, d, pytest.approx(s, abs=2e-6)) for i, d, s in sorted(got.get(qid, []))] == [(i + 1 + (offset or 0), r._id, r.score) for i, r in enumerate(expected)]


def test_live_index_changes_and_phrases(spark, tmp_path):
    path = str(tmp_path / "live")
    docs = spark.createDataFrame([("a", "heart of the matter heart attack"), ("b", "attack heart"), ("c", None)], "_id string, text string")
    assert live_index.change(spark, path, docs, ["text"]) == 1
    found = lambda words, version=None: [r._id for r in search.search(live_index.read_index(spark, path, version), words).collect()]
    assert found("attack") == ["b", "a"]
    phrases = lambda words: sorted((r._id, r.start, r.end) for r in live_index.phrase_match(live_index.live_postings(spark, path), words, "text").collect())
    assert phrases("heart attack") == [("a", 20, 32)] and phrases("heart of the matter") == [("a", 0, 19)] and phrases("the of") == []
    assert live_index.change(spark, path, docs.filter("_id = 'b'").withColumn("text", F.lit("lung")), ["text"]) == 2
    assert found("attack") == ["a"] and found("lung") == ["b"] and found("attack", 1) == ["b", "a"]
    assert live_index.change(spark, path, deletes=docs.filter("_id = 'a'")) == 3
    index = live_index.read_index(spark, path)
    assert found("attack heart") == [] and {r.term: r.df for r in index.freq.collect()} == {"lung": 1}
    assert [(r.n_docs, r.avg_length) for r in index.stats.collect()] == [(2, 0.5)]


def test_analysis_holds_few_terms(spark, tmp_path, monkeypatch):
    """Terms leave a task in small batches, in the middle of a text too; rows of one id count as one text."""
    import pyarrow as pa

    from corpusloom.functions import text as tx

    monkeypatch.setattr(tx, "ROWS_OUT", 10)
    batch = pa.RecordBatch.from_pydict({"_id": [1, 2, None, 4], "text": ["w " * 25, None, "x y", "Heart of heart"]})
    sizes = [b.num_rows for b in tx.located_terms(["text"])([batch])]
    assert max(sizes) <= 10 and sum(sizes) == 29
    grouped = [r for b in tx.grouped_terms(["text"])([batch, batch]) for r in b.to_pylist()]
    assert [(r["_id"], r["term"], len(r["places"])) for r in grouped[:4]] == [(1, "w", 25), (None, "x", 1), (None, "y", 1), (4, "heart", 2)]
    assert grouped[3]["places"] == [{"pos": 0, "start": 0, "end": 5}, {"pos": 2, "start": 9, "end": 14}] and len(grouped) == 8
    docs = spark.createDataFrame([("a", "b c b", "t"), ("a", "c", None), (None, "c", "c")], "_id string, text string, title string")
    places = {(r._id, r.field, r.term): (r.tf, [tuple(p) for p in r.places]) for r in search.term_places(docs, "_id", ["text", "title"]).collect()}
    assert places["a", "text", "c"] == (2, [(0, 0, 1), (1, 2, 3)]) and places["a", "text", "b"] == (2, [(0, 0, 1), (2, 4, 5)])
    assert set(places) == {("a", "text", "b"), ("a", "text", "c"), ("a", "title", "t"), (None, "text", "c"), (None, "title", "c")}


def test_radius_join_shares_pairs(spark, monkeypatch):
    """Two small tables with many pairs are many tasks' work, also if all rows lie in one place."""
    from corpusloom.operators import joins

    monkeypatch.setattr(joins, "PAIRS", 1000)
    near = [(i, 5.0 + i * 1e-5, 50.0) for i in range(200)]
    points = spark.createDataFrame([*near, (200, None, None)], "member int, lon double, lat double")
    centers = spark.createDataFrame([(f"c{i % 40}", 5.0, 50.0 + i * 1e-5) for i in range(60)], "center string, lon double, lat double")
    found = geo.geo_radius(points, centers, 50_000.0)
    sizes = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in sizes) == 200 * 60 and len(sizes) >= 4 and max(r["count"] for r in sizes) <= 6000
    large, small = spark.range(3).select("id", F.lit(1).alias("k")), spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("s"))
    pairs = joins.pair_join(large, small, ["k"], ["id"], ["s"])
    assert pairs.count() == pairs.distinct().count() == 15000
    nearest = geo.geo_radius(points, centers, 50_000.0, count=3, order="asc").collect()
    assert [(r.center, r.member) for r in nearest[:3]] == [("c0", 0), ("c0", 1), ("c0", 2)] and len(nearest) == 120


def _written(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_glob_keys_of_long_numbers(spark, tmp_path):
    """A sign other than zero before the last four: the glob's star takes it, the SQL does not."""
    from corpusloom.plans import QUERIES

    names = ["Customer#000001007", "Customer#000011007", "Customer#000101007", "customer#01007", "Customer#001a1007", "Customer#1007", None]
    sf = _written(spark, tmp_path, customer=spark.createDataFrame([(n, "x") for n in [*names, names[0]]], "c_name string, c_mktsegment string"))
    assert sorted(r.key for r in QUERIES["glob_keys"](spark, sf).collect()) == ["Customer#000001007", "customer#01007"]


def test_links_of_pages_with_one_url(spark, tmp_path):
    from corpusloom.plans import QUERIES

    page = lambda *hrefs: "".join(f'<a href="{h}">x</a>' for h in hrefs)
    data = [(1, "http://a.example/p", page("/x", "/y")), (2, "http://a.example/p", page("/y", "/z")), (3, "http://a.example/q", page("/y"))]
    sf = _written(spark, tmp_path, pages=spark.createDataFrame(data, "page_id long, url string, html string"))
    found = sorted((r.url[-1], r.link[-1]) for r in QUERIES["same_site_links"](spark, sf).collect())
    assert found == [("p", "x"), ("p", "y"), ("p", "z"), ("q", "y")]


def test_page_rules_run_once(spark):
    """Inside an expression every mention of a value is another evaluation, so the text's last rule is there once."""
    from corpusloom.functions import html

    frame = spark.createDataFrame([("<body><pre>a\n\tb</pre><p>c</body>",), ("<p>x</p>",), (None,)], "html string")
    item = frame.select(html.item(F.col("html")).alias("i"))
    plan = item._jdf.queryExecution().analyzed().toString()
    assert plan.count(r"\n(?:[ \t]*+\n)++") == 1 and plan.count("<blockquote") == 1
    assert [r[0] and r[0].content for r in item.collect()] == ["a\n\tb\n\nc", "x", None]


def test_spread_of_one_row_group(spark, tmp_path):
    """A file of one row group in many pieces has all rows in one of them."""
    from corpusloom.sources import tables

    spark.range(20000).selectExpr("id", "sha2(string(id), 256) as text").coalesce(1).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        stored = spark.read.parquet(str(tmp_path / "t"))
        assert stored.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        sizes = [r["count"] for r in tables.spread(stored).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(sizes) == 20000 and max(sizes) <= 5000


def test_archives_of_some_lines(spark):
    """A batch of many lines becomes several archives, so that a packing task holds few lines."""
    import io
    import tarfile

    import pyarrow as pa

    from corpusloom.plans import crawl_queries

    made = list(crawl_queries._pack([pa.RecordBatch.from_pydict({"value": [f"line {i}" for i in range(2500)]})]))
    assert len(made) == 3
    read = []
    for batch in made:
        with tarfile.open(fileobj=io.BytesIO(batch.column("content")[0].as_py()), mode="r:gz") as archive:
            read += archive.extractfile("a/part.jsonl").read().decode().split("\n")
    assert read == [f"line {i}" for i in range(2500)]


def test_chain_and_ingest_are_spread(spark, tmp_path, monkeypatch):
    """One file of a small table is no single task's work where its rows cost much."""
    from corpusloom.plans import QUERIES, crawl_queries, stream_queries

    class Seen(Exception):
        pass

    def crawled(seeds, pages, *_):
        raise Seen(pages.rdd.getNumPartitions())

    def ingested(items, *_, **__):
        raise Seen(items._jdf.queryExecution().analyzed().toString())

    monkeypatch.setattr(crawl_queries.crawl, "crawl", crawled)
    monkeypatch.setattr(stream_queries.ingest, "stream_ingest", ingested)
    customers = spark.createDataFrame([(1, "a", 2)], "c_custkey long, c_name string, c_nationkey int").coalesce(1)
    sf = _written(spark, tmp_path, customer=customers, pages=spark.createDataFrame([(1, "http://a.example/", "x")], "page_id long, url string, html string"))
    with pytest.raises(Seen) as chain:
        QUERIES["crawl_chain"](spark, sf)
    assert chain.value.args[0] >= spark.sparkContext.defaultParallelism
    with pytest.raises(Seen) as stream:
        QUERIES["stream_ingest_plain"](spark, sf)
    assert "Repartition" in stream.value.args[0]


def test_links_are_found_once(spark):
    """No filter below asks for links before the rows that have them are made; a null link stays a row."""
    from corpusloom.operators import extract

    data = [("http://a.example/", '<a href="/x">1</a><a href="/x">2</a>'), (None, '<a href="/y">3</a>'), ("http://a.example/n", None), ("http://a.example/e", "")]
    links = extract.page_links(spark.createDataFrame(data, "url string, html string").repartition(3))
    assert "Filter ((size" not in links._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in links.collect()} == {(None, None), ("http://a.example/", "http://a.example/x")}


@pytest.mark.parametrize("dictionary", [(), ("甲乙",)])
def test_postings_move_in_blocks(spark, tmp_path, monkeypatch, dictionary):
    """An index is shuffled and stored with many postings in a row, and they are those of a plain count."""
    texts = [f"Cat cat the {'dog' if i % 2 else 'Ähre'} 甲乙x{i % 3} ÉTÉ-Σ" for i in range(900)] + [None, "", "the", "  \n"]
    docs = spark.createDataFrame([(i % 700 if i % 50 else None, t, "src1") for i, t in enumerate(texts)], "_id int, text string, source string")
    path = str(tmp_path / "i")
    search.write_index(docs.repartition(3), ["text", "source"], path, dictionary=dictionary)
    expected, lengths = Counter(), defaultdict(list)
    for i, text in enumerate(texts):
        for field, value in (("text", text or ""), ("source", "src1")):
            found = tx.terms_of(value, dictionary=dictionary)
            lengths[field].append(len(found))
            expected.update((i % 700 if i % 50 else None, field, t, n, len(found)) for t, n in Counter(found).items())
    lazy = search.build_index(docs, ["text", "source"], dictionary=dictionary)
    for index in (search.read_index(spark, path), lazy):
        assert Counter(tuple(r) for r in index.postings.select("_id", "field", "term", "tf", "length").collect()) == expected
        assert {r.field: (r.n_docs, r.avg_length) for r in index.stats.collect()} == {f: (len(n), sum(n) / len(n)) for f, n in lengths.items()}
        df = Counter()
        for (_, field, term, _, _), n in expected.items():
            df[field, term] += n
        assert {(r.field, r.term): r.df for r in index.freq.collect()} == df
    stored = [spark.read.parquet(str(part)).count() for part in (tmp_path / "i").iterdir() if part.name not in ("stats", "freq")]
    assert max(stored) < sum(expected.values()) / 10
    # little text at once and few documents in a row: the same postings, a long text alone
    monkeypatch.setattr(tx, "TEXT_BYTES", 100)
    monkeypatch.setattr(tx, "BLOCK_DOCS", 2)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3, 4]), pa.array(["b d d", "b", "", "b " * 90, "b c"])], names=["_id", "_text0"])
    rows_ = [r for out in tx.term_blocks(["text"])(iter([batch.slice(0, 0), batch, batch.slice(4)])) for r in out.to_pylist()]
    assert all(len(r["ids"]) == r["n"] <= 2 for r in rows_ if r["term"])
    made = sorted((i, r["term"], tf, n) for r in rows_ if r["term"] for i, tf, n in zip(r["ids"], r["tfs"], r["lengths"]))
    assert made == [(0, "b", 1, 3), (0, "d", 2, 3), (1, "b", 1, 1), (3, "b", 90, 90), (4, "b", 1, 2), (4, "b", 1, 2), (4, "c", 1, 2), (4, "c", 1, 2)]
    assert sum(r["n"] for r in rows_ if r["term"] is None) == 6 and sum(r["total"] for r in rows_ if r["term"] is None) == 98


def test_live_index_in_blocks(spark, tmp_path):
    """Many postings of a term are one stored row; repeated and null ids, a merge of the last parts, against plain counts."""
    path = str(tmp_path / "blocks")
    data = [(i, f"Der Arzt the {'Herz' if i % 3 else 'Auge'} 甲{i % 2} É der arzt", None if i % 4 else "t") for i in range(60)]
    data += [(7, "arzt Ende", None), (None, "arzt", "x"), (None, "y", "x")]
    make = lambda rows_: spark.createDataFrame(rows_, "_id int, text string, title string")

    def check(live):
        texts, places, lengths = defaultdict(list), defaultdict(list), defaultdict(list)
        for i, *values in live:
            for field, value in zip(("text", "title"), values):
                texts[i, field].append(value or "")
        for (i, field), of_id in texts.items():
            found = [(m.group(), p, *m.span()) for t in of_id for p, m in enumerate(re.finditer(tx.token_pattern(), t.lower())) if m.group() not in tx.STOP_WORDS]
            lengths[field] += [0 if i is None else len(found)] * len(of_id)
            for term in {f[0] for f in found} if i is not None else ():
                at = sorted(f[1:] for f in found if f[0] == term)
                places[field, term] += [(i, len(at), len(found), at)] * len(of_id)
        got = defaultdict(list)
        for r in live_index.live_postings(spark, path).collect():
            got[r.field, r.term].append((r._id, r.tf, r.length, [tuple(p) for p in r.places]))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in places.items()}
        index = live_index.read_index(spark, path)
        assert {(r.field, r.term): r.df for r in index.freq.collect()} == {k: len(v) for k, v in places.items()}
        assert {r.field: (r.n_docs, r.avg_length) for r in index.stats.collect()} == {f: (len(n), sum(n) / len(n)) for f, n in lengths.items()}
        return sum(map(len, places.values()))

    live_index.change(spark, path, make(data).coalesce(1), ["text", "title"])
    total = check(data)
    assert spark.read.parquet(f"{path}/part-1/postings").count() < total / 10
    new = [(3, "anders", "neu"), (7, "der Arzt", None)]
    live_index.change(spark, path, make(new), ["text", "title"])
    live_index.change(spark, path, deletes=make([(i, "", "") for i in (3, 5, 9, 11)]))
    assert [name for name, _ in live_index.parts(spark, path)] == ["part-1", "part-3-merged"]
    check([r for r in data if r[0] not in (3, 5, 7, 9, 11)] + new[1:])
    wanted = live_index.live_postings(spark, path).filter("term = 'arzt'")
    assert "EqualTo(term,arzt)" in wanted._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_small_segments(monkeypatch):
    """Numbers of any size in bytes; segments and blocks of few documents; marked documents go, others stay as they are."""
    from corpusloom.functions import blocks

    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40])
    data, sizes = blocks.packed(numbers)
    assert blocks.unpacked(data)[0].tolist() == numbers.tolist() and sizes.tolist() == [1, 1, 1, 2, 2, 3, 5, 6]
    monkeypatch.setattr(blocks, "SEGMENT_DOCS", 3)
    monkeypatch.setattr(tx, "BLOCK_DOCS", 2)
    texts = [["b d d"], ["b"], [None], ["b " * 90], ["c b", "b"], [], ["😀b-Σ", "É b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.list_(pa.string()))], names=["_id", "_text0"])
    made = list(blocks.place_blocks(["text"], (), 8)(iter([batch.slice(0, 0), batch.slice(0, 2), batch.slice(2)])))
    assert [b.column("ids")[-1].as_py() for b in made] == [[0, 1, 2], [3, 4, 5], [6]] and [b.column("segment")[0].as_py() for b in made] == [8, 9, 10]
    assert [b.column("lengths")[-1].as_py() for b in made] == [[3, 1, 0], [90, 3, 0], [4]]

    def postings(b):
        n = b.column("n").to_numpy().astype(int)
        assert max(n) <= 2
        no, tf = blocks._documents(n, b.column("docs"))
        return sorted(zip(np.repeat(b.column("term").to_pylist(), n).tolist(), no.tolist(), tf.tolist()))

    one, two, three = (b.slice(0, b.num_rows - 1).select(blocks.NAMES) for b in made)
    assert postings(one) == [("b", 0, 1), ("b", 1, 1), ("d", 0, 2)] and postings(two) == [("b", 0, 90), ("b", 1, 2), ("c", 1, 1)]
    assert postings(three) == [("b", 0, 2), ("é", 0, 1), ("σ", 0, 1)]
    bits = np.zeros((1, 512), np.uint8)
    bits[0, 0] = 0b01
    monkeypatch.setattr(blocks, "_marks_at", lambda path: (np.array([9]), bits))
    first, second = blocks.without_marked("")(iter([one, two]))
    assert first is one and postings(second) == [("b", 1, 2), ("c", 1, 1)]
    assert second.column("places")[0].as_py() == blocks._pack_places(np.array([0, 1]), np.array([0, 2]), np.array([2]), np.array([1]))[0].as_py()
    assert [r for b in blocks.marked_counts("")(iter([one, two])) for r in b.to_pylist()] == [{"field": "text", "term": "b", "df": -1}]


def test_radius_join_moves_narrow_rows(spark, monkeypatch):
    """Places on the sphere are made behind the shuffles of both sides."""
    from corpusloom.operators import joins

    monkeypatch.setattr(joins, "PAIRS", 1000)
    points = spark.createDataFrame([(i, 5.0 + i * 1e-5, 50.0) for i in range(200)], "member int, lon double, lat double")
    near = geo.geo_radius_by_member(points, points.limit(100), 50_000.0)
    _, left, right = near._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
    assert "_px" not in left + right and "_cx" not in right
    assert near.count() == near.distinct().count() == 200 * 100
