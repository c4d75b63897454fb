"""Keyed operators over streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corpusloom.functions import strings
from corpusloom.operators import merge, pubsub


def stream_unseen(requests: DataFrame, fp: str = "fingerprint", ts: str = "ts", keep: str = "30 days") -> DataFrame:
    """First request of each fingerprint; a fingerprint is forgotten after ``keep``."""
    return requests.withWatermark(ts, keep).dropDuplicatesWithinWatermark([fp])


def stream_counters(deltas: DataFrame, keys: Sequence[str], delta: str = "delta") -> DataFrame:
    """Running counters; write them in update or complete mode."""
    return merge.counters(deltas, keys, delta)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_COUNTER_STATE = "value bigint, expire_at timestamp, last timestamp"
_COUNTER_ROW = "key string, value bigint, expire_at timestamp, expired boolean"


@contextmanager
def state_with_timers(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which state with timers needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class ExpiringCounters(StatefulProcessor):
    """State per key: value, expiry and the time of the last command."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counter", _COUNTER_STATE)

    def handleInputRows(self, key, rows, timerValues):
        parts = list(rows)
        commands = pd.concat(parts) if len(parts) > 1 else parts[0]
        commands = commands.sort_values(["ts", "seq"], kind="stable")
        value = expire_at = last = None
        if self.state.exists():
            value, expire_at, last = (None if pd.isna(v) else v for v in self.state.get())
            value = int(value)
        before = expire_at
        for op, amount, ts in zip(commands["op"], commands["amount"], commands["ts"]):
            # a command that is late for its key is applied at the key's time
            last = ts if last is None or ts > last else last
            if expire_at is not None and expire_at <= last:
                value = expire_at = None
            if op == "incr":
                value = (value or 0) + int(amount)
            elif op == "set":
                value, expire_at = int(amount), None
            elif op == "del":
                value = expire_at = None
            elif value is not None and op == "persist":
                expire_at = None
            elif value is not None and op == "expire":
                expire_at = last + pd.Timedelta(seconds=int(amount))
                if expire_at <= last:
                    value = expire_at = None
        if before is not None and before != expire_at:
            self.handle.deleteTimer(_millis(before))
        if expire_at is not None and before != expire_at:
            self.handle.registerTimer(_millis(expire_at))
        if value is None:
            self.state.clear()
        else:
            self.state.update((value, _plain(expire_at), _plain(last)))
        yield _counter_row(key, value, expire_at, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            self.state.clear()
        yield _counter_row(key, None, None, True)

    def close(self) -> None:
        pass


def _millis(at) -> int:
    return -(-int(pd.Timestamp(at).value) // 1_000_000)


def _plain(at):
    return None if at is None else pd.Timestamp(at).to_pydatetime()


def _counter_row(key, value, expire_at, expired) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "key": [key[0]],
            "value": pd.array([value], dtype="Int64"),
            "expire_at": pd.Series([expire_at], dtype="datetime64[us]"),
            "expired": [expired],
        }
    )


def stream_expiring_counters(commands: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Counters with time to live of a stream of ``(key, op, amount, ts, seq)``: ``(key, value, expire_at, expired)``.

    ``incr`` adds and leaves the expiry alone, ``set`` stores and clears it, ``expire`` sets it to ``amount`` seconds
    after the command, ``persist`` clears it, ``del`` removes the key; ``expire`` and ``persist`` of an absent key do
    nothing.  A command at or after the expiry finds no key.  Commands of a key in one batch are taken by (ts, seq).

    Write it in update mode: one row per key that a batch touches (null if the key is gone), and one row with
    ``expired`` when the watermark, ``late`` behind the newest command, passes a key's expiry; its state is dropped then.
    State is kept for keys that are there; start the query inside ``state_with_timers``.
    """
    rows = commands.select(F.col("key").cast("string").alias("key"), "op", F.col("amount").cast("long").alias("amount"), "ts", F.col("seq").cast("long").alias("seq"))
    return (
        rows.withWatermark("ts", late)
        .groupBy("key")
        .transformWithStateInPandas(
            statefulProcessor=ExpiringCounters(), outputStructType=_COUNTER_ROW, outputMode="Update", timeMode="EventTime"
        )
    )


def stream_pop(spark: SparkSession, paths: Sequence[str], schema: T.StructType, kind: str = "json") -> DataFrame:
    """Items of several lists, with the place of their list among the arguments in ``priority``."""
    parts = [
        spark.readStream.schema(schema).format(kind).load(path).withColumn("priority", F.lit(i))
        for i, path in enumerate(paths)
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def pop_into(queue: DataFrame, path: str, checkpoint: str, seq: str = "seq", side: str = "left") -> StreamingQuery:
    """Consume what is there: the first list first, each list from its left or right end.

    A batch is written range-partitioned in that order.
    """

    def write(batch: DataFrame, number: int) -> None:
        order = F.col(seq).asc() if side == "left" else F.col(seq).desc()
        batch.orderBy("priority", order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        queue.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_route(messages: DataFrame, subs: DataFrame) -> DataFrame:
    """Deliveries of a stream of messages to a static table of subscriptions.

    A message meets the subscriptions whose literal start is a start of its
    channel: one equality join for exact and pattern subscriptions, no state.
    """
    exact = pubsub.exact(subs).select(
        "subscriber", F.lit(None).cast("string").alias("pattern"), F.col("channel").alias("_start"), F.lit(None).cast("string").alias("_regex")
    )
    by_pattern = pubsub.patterns(subs).select(
        "subscriber",
        "pattern",
        strings.glob_prefix(F.col("pattern")).alias("_start"),
        strings.glob_column_regex(F.col("pattern")).alias("_regex"),
    )
    ready = exact.unionByName(by_pattern)
    starts = messages.withColumn("_start", pubsub._prefixes("channel"))
    hit = F.when(F.col("_regex").isNull(), F.col("_start") == F.col("channel")).otherwise(F.expr("channel rlike _regex"))
    return starts.join(ready, "_start").filter(hit).drop("_start", "_regex")
