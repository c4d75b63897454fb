"""Streams against their batch forms, over several micro-batches."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from corpusloom.streaming import ingest, keyed, moves


def test_ingest_over_several_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    paths = [str(tmp_path / name) for name in ("raw", "plain", "sites", "state")]

    def put(name, *items):
        (source / name).write_text("\n".join([*(json.dumps(i) for i in items), "{broken"]))

    def drain():
        ingest.stream_ingest(ingest.stream_items(spark, str(source)), *paths, default_url="http://unknown.example/").awaitTermination()

    put("1.json", {"url": "http://x.b.com/1", "title": "t", "content": "**old**"}, {"code": "c7", "content": "y"})
    drain()
    put("2.json", {"url": "http://x.b.com/1?", "title": "t", "content": "**new**"}, {"url": "http://a.com/", "content": "z"})
    drain()
    plain = {r._id: r for r in ingest.current(spark, paths[1]).collect()}
    assert len(plain) == 3 and plain["c7"].content == "y"
    by_url = {r.url: r for r in plain.values()}
    assert by_url["http://x.b.com/1?"].content == "new"
    codes = {r.site: r.site_code for r in spark.read.parquet(paths[2]).filter(F.col("site").isNotNull()).collect()}
    assert codes == {"b.com": by_url["http://x.b.com/1?"].site_code, "a.com": by_url["http://a.com/"].site_code}
    assert len(set(codes.values())) == 2
    raw = {r.content for r in ingest.current(spark, paths[0]).collect()}
    assert raw == {"**new**", "y", "z"}


def test_moves_are_replayed_without_effect(spark, tmp_path):
    """Requests wait for items, items for requests; a batch that is worked off twice moves nothing twice."""
    root = str(tmp_path / "moves")
    work = moves.queue_moves(root)
    schema = "kind string, list string, to string, seq long, value string"
    batches = [
        [("push", "a", None, 1, "x"), ("push", "a", None, 2, "y"), ("move", "b", "t", 3, None)],
        [("move", "a", "t", 4, None), ("push", "b", None, 5, "z"), ("push", None, None, 6, "lost")],
        [("move", "a", "t", 7, None), ("move", "a", "u", 8, None)],
    ]
    for number, commands in enumerate(batches):
        for _ in range(2):
            work(spark.createDataFrame(commands, schema), number)
    got = sorted((r.list, r.position, r.value) for r in moves.target_lists(spark, root).collect())
    assert got == [("t", 0, "y"), ("t", 1, "z"), ("t", 2, "x")]
    assert [tuple(r) for r in moves.waiting(spark, root).collect()] == [("a", "move", 2, None)]


def test_counters_expire_by_timer(spark, tmp_path):
    """An increment leaves the expiry alone; a key whose expiry the watermark passes is reported once and starts anew."""
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "key string, op string, amount long, ts timestamp, seq long"
    found = []

    def drain(*commands):
        rows = [(k, op, n, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), i) for i, (k, op, n, s) in enumerate(commands)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        counters = keyed.stream_expiring_counters(spark.readStream.schema(schema).parquet(source))
        out = []
        with keyed.state_with_timers(spark):
            job = counters.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True)
            job.foreachBatch(lambda batch, _: out.extend((r.key, r.value, r.expired) for r in batch.collect())).start().awaitTermination()
        found.extend(out)
        return sorted(out, key=str)

    got = drain(("a", "incr", 2, 0), ("a", "expire", 10, 1), ("a", "incr", 3, 5), ("b", "set", 7, 5), ("b", "expire", 100, 5), ("b", "persist", 0, 6), ("c", "expire", 5, 6))
    assert ("a", 5, False) in got and ("b", 7, False) in got and ("c", None, False) in got
    got = drain(("b", "incr", 1, 50), ("d", "incr", 1, 60))
    assert ("b", 8, False) in got and ("d", 1, False) in got
    got = drain(("a", "incr", 1, 61), ("b", "del", 0, 62))
    assert ("a", 1, False) in got and ("b", None, False) in got
    assert sum(r == ("a", None, True) for r in found) == 1 and not any(r[0] == "b" and r[2] for r in found)
