"""Archives of JSON lines and files of pages, opened by the tasks that read them.

Spark's file source lists the archives, in batch or as a stream with its own log of files seen, but only their paths are
read by it.  A task opens its archives through ``pyarrow.fs`` and lets their members pass in small batches, so no archive
is ever one value and its size has no limit.
"""

from __future__ import annotations

import os
import tarfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

SUFFIX = "*.jsonl.tgz"
LINES_PER_BATCH = 2000
LINE = "archive string, member string, line string"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Spark path; one without a scheme is local."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def archive_paths(spark: SparkSession, path: str, suffix: str = SUFFIX) -> DataFrame:
    """The archives of a folder, ``(path)``; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path).select("path")


def stream_archive_paths(spark: SparkSession, path: str, suffix: str = SUFFIX, files_per_batch: int | None = None) -> DataFrame:
    """The same as a stream: each archive that arrives is there once."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", suffix)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select("path")


def _members(path: str) -> Iterator[pa.RecordBatch]:
    system, name = place(path)
    # read front to back, so the archive is decompressed once and never held
    with system.open_input_stream(name, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as archive:
        for member in archive:
            if not (member.isfile() and member.name.endswith("jsonl")):
                continue
            lines: list[str] = []
            for line in archive.extractfile(member):
                lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
                if len(lines) >= LINES_PER_BATCH:
                    yield _lines(path, member.name, lines)
                    lines = []
            yield _lines(path, member.name, lines)


def _lines(path: str, member: str, lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    columns = [pa.array([path] * n, pa.string()), pa.array([member] * n, pa.string()), pa.array(lines, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["archive", "member", "line"])


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            yield from _members(path)


def archive_lines(paths: DataFrame) -> DataFrame:
    """Lines ``(archive, member, line)`` of all members ending in ``jsonl`` of the archives in ``paths(path)``."""
    return paths.select("path").mapInArrow(_read, LINE)
