"""Index tables as versioned Parquet folders reached through a name."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECES = 4  # per core, so that a few long texts in one of them hold up little


def create_index(spark: SparkSession, name: str, schema: T.StructType, path: str) -> None:
    """Declare an empty typed table at a path."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({columns}) USING parquet LOCATION '{path}'")


def delete_index(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def alias(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Let ``name`` stand for the table version at ``path``."""
    table = spark.read.parquet(path)
    table.createOrReplaceTempView(name)
    return table


def publish(df: DataFrame, name: str, root: str, partitions: int | None = None) -> str:
    """Write a new version below ``root`` and let ``name`` stand for it.

    Readers of the old version are not disturbed; its path stays valid.
    """
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df if partitions is None else df.repartition(partitions)).write.parquet(path)
    alias(df.sparkSession, name, path)
    return path


def scan_all(spark: SparkSession, name: str, clause: Column | None = None) -> DataFrame:
    """Every document of a named table that satisfies an optional clause."""
    table = spark.table(name)
    return table if clause is None else table.filter(clause)


def spread(df: DataFrame) -> DataFrame:
    """A stored table over all cores, even if its rows lie in fewer pieces.

    A file of few row groups is cut into as many pieces as its size asks for, but only those with the start of a group
    have rows; so pieces count by their rows, which the files' footers tell.  A table whose largest piece is more than
    twice a core's share is shuffled; a large one in many pieces stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        sizes = df.groupBy(F.spark_partition_id().alias("piece")).agg(F.count(F.lit(1)).alias("n"))
        most, total = sizes.agg(F.max("n"), F.sum("n")).first()
        if (most or 0) * cores <= 2 * (total or 0):
            return df
    return df.repartition(PIECES * cores)
