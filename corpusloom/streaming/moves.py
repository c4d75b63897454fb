"""Moves between two tables of lists as a stream: the tail of a list goes to the head of another, or the request waits.

Items come in at the head of a list of the first table and leave at its tail, so the i-th request of a list takes the
i-th item that ever came into it, whichever of the two arrives first.  A batch therefore needs of the past only the
numbers of items and requests per list and those that still wait for each other.

Every output of a batch is a folder with the batch's number, made from the batch's commands and the folders of the batch
before: a replayed batch writes the same moves again and moves nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.ranking import with_rank

_COUNTS = T.StructType([T.StructField("list", T.StringType()), T.StructField("items", T.LongType()), T.StructField("requests", T.LongType())])


def _of_batch(spark: SparkSession, path: str, schema: T.StructType, number: int) -> DataFrame:
    if number < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch={number}")


def queue_moves(root: str) -> Callable[[DataFrame, int], None]:
    """The work of one batch of commands ``(kind, list, to, seq, value)``.

    ``push`` puts ``value`` at the head of ``list``; ``move`` takes the tail of ``list`` to the head of ``to``.  Commands
    of a batch are taken by ``seq``, unique per list and kind.  Written below ``root``: ``moves`` (list, to, n, value,
    seq of the request), ``waiting`` and ``counts``; n counts the moves out of a list from 0.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("kind", F.col("list").cast("string").alias("list"), F.col("to").cast("string").alias("to"), F.col("seq").cast("long").alias("seq"), F.col("value").cast("string").alias("value"))

        def keep(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
            return spark.read.schema(df.schema).parquet(f"{root}/{name}/batch={number}")

        commands = keep(rows.filter(F.col("list").isNotNull() & F.col("kind").isin("push", "move")), "commands")
        before = _of_batch(spark, f"{root}/counts", _COUNTS, number - 1)
        ranked = with_rank(commands, ["list", "kind"], ["seq"], "_rank", "_size")
        # one row per list and kind, and the numbers of earlier batches
        mine = before.select(F.col("list").alias("_l"), "items", "requests")
        start = F.coalesce(F.when(F.col("kind") == "push", F.col("items")).otherwise(F.col("requests")), F.lit(0))
        numbered = ranked.join(mine, F.col("list") == F.col("_l"), "left").withColumn("n", start + F.col("_rank"))
        numbered = numbered.select("kind", "list", "to", "seq", "value", "n")
        waiting = _of_batch(spark, f"{root}/waiting", numbered.schema, number - 1)
        there = keep(numbered.unionByName(waiting), "open")
        items = there.filter("kind = 'push'").select("list", "n", "value")
        requests = there.filter("kind = 'move'").select("list", "n", "to", "seq")
        moved = keep(items.join(requests, ["list", "n"]).select("list", "to", "n", "value", "seq"), "moves")
        # of what met nothing, per list either items or requests are left
        keep(there.join(moved.select("list", "n"), ["list", "n"], "left_anti").select(*numbered.columns), "waiting")
        count = lambda kind: F.count_if(F.col("kind") == kind)
        new = commands.groupBy("list").agg(count("push").alias("items"), count("move").alias("requests"))
        keep(before.unionByName(new).groupBy("list").agg(F.sum("items").alias("items"), F.sum("requests").alias("requests")), "counts")

    return write


def stream_moves(commands: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the moves of a stream of commands; ``target_lists`` reads what they have built."""
    job = commands.writeStream.foreachBatch(queue_moves(root)).option("checkpointLocation", checkpoint)
    return job.trigger(**(trigger or {"availableNow": True})).start()


def target_lists(spark: SparkSession, root: str) -> DataFrame:
    """``(list, position, value)`` of the second table, the head at position 0.

    Moves into one list are ordered by batch, source list and number; each pushes what is there one place back.
    """
    moves = spark.read.parquet(f"{root}/moves").filter(F.col("to").isNotNull())
    ranked = with_rank(moves.select("to", "batch", "list", "n", "value"), ["to"], ["batch", "list", "n"], "_rank", "_size")
    return ranked.select(F.col("to").alias("list"), (F.col("_size") - 1 - F.col("_rank")).alias("position"), "value")


def waiting(spark: SparkSession, root: str) -> DataFrame:
    """``(list, kind, n, value)``: items and requests of the last batch that have not met."""
    rows = spark.read.parquet(f"{root}/waiting")
    last = rows.sparkSession.read.parquet(f"{root}/counts").agg(F.max("batch")).scalar()
    return rows.filter(F.col("batch") == last).select("list", "kind", "n", "value")
