"""Streams of items into the two index tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import text, urls
from corpusloom.operators import merge, sites
from corpusloom.schemas import INGEST, SITE
from corpusloom.sources.files import good_rows, with_document_id

ITEM_COLUMNS = ("_id", "url", "title", "keywords", "description", "content", "origin")


def stream_items(spark: SparkSession, path: str, schema: T.StructType = INGEST, files_per_batch: int | None = None) -> DataFrame:
    """A folder that receives JSON-lines files, as a stream; bad lines are skipped."""
    reader = spark.readStream.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return good_rows(reader.json(path))


def raw_documents(items: DataFrame, default_url: str, origin: str = "zh") -> DataFrame:
    """Items with id and origin; of items with one id in a batch the last ``seq`` stays."""
    docs = with_document_id(items.withColumn("origin", F.lit(origin)), default_url)
    if "seq" in docs.columns:
        return merge.newest(docs.select(*ITEM_COLUMNS, "seq"), ["_id"], "seq").select(*ITEM_COLUMNS)
    return docs.select(*ITEM_COLUMNS).dropDuplicates(["_id"])


def _sited(docs: DataFrame, rules: DataFrame | None) -> DataFrame:
    return sites.with_site(docs) if rules is None else sites.site_by_rules(docs, rules)


def plain_documents(raw: DataFrame, dim: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Raw documents with style removed and the site code added; ``rules(suffix)`` are public suffixes."""
    clean = raw.withColumn("content", text.remove_style(F.col("content")))
    return sites.enrich(_sited(clean, rules), dim).select(*ITEM_COLUMNS, "site_code")


def _batches(spark: SparkSession, path: str, schema: T.StructType, before: int) -> DataFrame:
    """Rows of the earlier batches of a folder written batch by batch."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(full).parquet(path)
    return rows.filter(F.col("batch") < before).drop("batch")


def two_sinks(
    raw_path: str, plain_path: str, site_path: str, origin: str, default_url: str, rules: DataFrame | None = None
) -> Callable[[DataFrame, int], None]:
    """The work of one micro-batch.

    The raw documents are written first and read back, so all else comes from the same rows.  Every output of a batch is
    a folder named by the batch number and site codes are drawn from earlier batches only, so a replay writes the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        made = raw_documents(batch, default_url, origin)
        made.write.mode("overwrite").parquet(f"{raw_path}/batch={number}")
        raw = spark.read.schema(made.schema).parquet(f"{raw_path}/batch={number}")
        known = _batches(spark, site_path, SITE, number)
        found = _sited(raw.select("url"), rules).select("site", F.lit(number).alias("first_seen"))
        dim = sites.assign_site_codes(found, known)
        fresh = dim.join(known.select("site"), "site", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{site_path}/batch={number}")
        all_sites = _batches(spark, site_path, SITE, number + 1)
        plain_documents(raw, all_sites, rules).write.mode("overwrite").parquet(f"{plain_path}/batch={number}")

    return write


def stream_ingest(
    items: DataFrame,
    raw_path: str,
    plain_path: str,
    site_path: str,
    checkpoint: str,
    origin: str = "zh",
    *,
    default_url: str,
    rules: DataFrame | None = None,
    **trigger,
) -> StreamingQuery:
    """Start the stream of items into the raw and the plain table; ``default_url`` is for items without url and code.

    Sites are told by ``rules(suffix)``, a table of public suffixes, or by the short built-in list.
    """
    return (
        items.writeStream.foreachBatch(two_sinks(raw_path, plain_path, site_path, origin, default_url, rules))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table a stream has written: of each id the row of its last batch."""
    return merge.newest(spark.read.parquet(path), ["_id"], "batch")
