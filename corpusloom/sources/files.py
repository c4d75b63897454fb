"""File sources and sinks of the ingest side."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text, urls
from corpusloom.operators.extract import extract_items
from corpusloom.schemas import INGEST
from corpusloom.sources import archives

CORRUPT = "_corrupt_record"
LINES_PER_BATCH = 2000


def _with_origin(df: DataFrame, origin: str | None) -> DataFrame:
    return df if origin is None else df.withColumn("origin", F.lit(origin))


def read_jsonl(spark: SparkSession, path: str, origin: str | None = None, schema: T.StructType = INGEST) -> DataFrame:
    """All ``*.jsonl`` files of a folder; a line that does not parse is kept in ``_corrupt_record``."""
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(path)
    return parse_lines(lines.filter(F.trim("value") != ""), origin, schema, "value")


def parse_lines(lines: DataFrame, origin: str | None = None, schema: T.StructType = INGEST, line: str = "line") -> DataFrame:
    """JSON texts to rows, with the same treatment of bad lines as ``read_jsonl``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return _with_origin(lines.select(F.from_json(F.col(line), schema, options).alias("_j")).select("_j.*"), origin)


def good_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_lines(rows: DataFrame) -> DataFrame:
    """Lines to report."""
    return rows.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"), "origin")


def _archive_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
                for member in archive:
                    if not (member.isfile() and member.name.endswith("jsonl")):
                        continue
                    lines = []
                    for raw in archive.extractfile(member):
                        lines.append(raw.decode("utf-8", "replace").rstrip("\r\n"))
                        if len(lines) >= LINES_PER_BATCH:
                            yield pd.DataFrame({"line": lines})
                            lines = []
                    if lines:
                        yield pd.DataFrame({"line": lines})


def read_jsonl_archives(
    spark: SparkSession, path: str, origin: str = "en", schema: T.StructType = INGEST, spread: int | None = None
) -> DataFrame:
    """Members ending in ``jsonl`` of all ``*.jsonl.tgz`` files of a folder.

    An archive is one task's work; its members are streamed, so it may have any size.
    ``spread`` repartitions the lines when there are few large archives.
    """
    lines = archives.archive_lines(archives.archive_paths(spark, path)).select("line").filter(F.trim("line") != "")
    return parse_lines(lines if spread is None else lines.repartition(spread), origin, schema)


def stream_jsonl_archives(
    spark: SparkSession, path: str, origin: str = "en", schema: T.StructType = INGEST, files_per_batch: int | None = None
) -> DataFrame:
    """The same for a folder that receives archives, as a stream."""
    paths = archives.stream_archive_paths(spark, path, files_per_batch=files_per_batch)
    return parse_lines(archives.archive_lines(paths).select("line").filter(F.trim("line") != ""), origin, schema)


def archive_rows(
    files: DataFrame, origin: str = "en", schema: T.StructType = INGEST, spread: int | None = None
) -> DataFrame:
    """The same for a table with one archive of at most 2 GB per row in ``content``."""
    lines = files.select("content").mapInPandas(_archive_lines, "line string").filter(F.trim("line") != "")
    return parse_lines(lines if spread is None else lines.repartition(spread), origin, schema)


def read_html_tree(spark: SparkSession, path: str, origin: str = "zh") -> DataFrame:
    """Items of all html/htm files below a folder; the file's path is kept in ``path``."""
    pages = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*{html,htm}")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
    )
    items = extract_items(pages, url="path")
    return items.withColumnRenamed("url", "path").withColumn("url", F.lit(None).cast("string")).withColumn("origin", F.lit(origin))


def with_document_id(docs: DataFrame, default_url: str) -> DataFrame:
    """Add ``_id``, and ``default_url`` to documents that have neither url nor code."""
    code = F.col("code") if "code" in docs.columns else F.lit(None).cast("string")
    made: Column = urls.document_id(F.col("url"), code, F.col("title"), F.col("keywords"))
    return docs.withColumn("_id", made).withColumn("url", urls.document_url(F.col("url"), code, default_url))


def read_pipe_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines with fields split on ``' | '``; the first line of each file names the columns."""
    return spark.read.option("header", True).option("sep", " | ").option("quote", "").csv(path)


def seed_urls(df: DataFrame, column: str) -> DataFrame:
    """One column of a seed table as crawl seeds."""
    return df.select(F.col(column).cast("string").alias("url")).filter(F.col("url").isNotNull() & (F.col("url") != ""))


def dump_values(df: DataFrame, column: str, path: str) -> None:
    """A queue as JSON lines ``{"value": v}``."""
    df.select(F.to_json(F.struct(F.col(column).alias("value"))).alias("line")).write.mode("overwrite").text(path)


def load_values(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The dumped queue, cast to ``kind``."""
    raw = spark.read.schema("value string").json(path)
    return raw.select(F.col("value").cast(kind).alias("value"))


def question_lines(items: DataFrame) -> DataFrame:
    """Titles and description tokens that are questions, one per row."""
    return items.select(F.explode(text.questions(F.col("title"), F.col("description"))).alias("value"))


def append_questions(items: DataFrame, path: str) -> None:
    question_lines(items).write.mode("append").text(path)
