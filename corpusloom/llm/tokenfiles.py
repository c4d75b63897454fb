"""Token ids in binary files with one shared zstandard dictionary, one frame per document and an offset index.

A folder holds ``dictionary`` (trained on serialized id arrays, may be empty), data files, and ``manifest.parquet`` with
one row per data file in order: name, documents, tokens, tokens before it, smallest and largest doc_id, hash of the
dictionary.  A data file is

    head     ``TKID``, version, bytes per id (2 or 4), two zero bytes, SHA-256 of the dictionary
    frames   one zstandard frame per document: its ids, little-endian, compressed with the dictionary
    index    per document: 64-bit end of its frame, 64-bit tokens before it in the file, doc_id, a byte that is 1 for no doc_id
    tail     place of the index, number of documents, CRC-32 of the index, ``TKID``

so a document is found by its index entry and read alone: one short frame, however large the file.

Writing is a Spark data source.  Each task writes files under names of its own and names them in its commit message;
only files of successful attempts get into the manifest, which is written last.  A lost executor leaves at most files
that no manifest names.  Files are ordered as the rows are: sort them over range partitions before.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from corpusloom.llm.packing import END_ID, encoder
from corpusloom.llm.work import small_batches

MAGIC, VERSION = b"TKID", 1
_HEAD = struct.Struct("<4sBBxx32s")
_TAIL = struct.Struct("<QQI4s")
_ENTRY = np.dtype([("end", "<u8"), ("before", "<u8"), ("doc_id", "<i8"), ("no_id", "u1")])
FILE_BYTES = 256 << 20  # a task starts a new file after so many compressed bytes
READ_BYTES = 32 << 20  # compressed bytes that one task reads, and one document at least
BATCH_BYTES = 8 << 20
LEVEL = 3
DICTIONARY_BYTES = 112_640
SAMPLE_DOCS, SAMPLE_CHARS = 1_000, 4_000  # the dictionary is trained on so many documents of at most so many characters
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
FORMAT = "token_ids"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))


def _read(path: str, name: str) -> bytes:
    system, base = _place(path)
    with system.open_input_stream(f"{base}/{name}") as source:
        return source.read()


def _write(path: str, name: str, content: bytes) -> None:
    """Written under another name first, so that a reader sees all of it or nothing."""
    system, base = _place(path)
    system.create_dir(base, recursive=True)
    draft = f"{base}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as sink:
        sink.write(content)
    system.move(draft, f"{base}/{name}")


def _zstd_dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from serialized id arrays; what is too little for training is taken as it stands."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


@dataclass
class _Files(WriterCommitMessage):
    partition: int
    rows: list[dict] = field(default_factory=list)


class _OneFile:
    """A data file while it is written."""

    def __init__(self, path: str, width: int, content: bytes, compressor: zstandard.ZstdCompressor):
        self.name = f"ids-{uuid.uuid4().hex}.tkid"
        system, base = _place(path)
        self.sink = system.open_output_stream(f"{base}/{self.name}")
        self.width, self.compressor = width, compressor
        self.digest = hashlib.sha256(content)
        self.sink.write(_HEAD.pack(MAGIC, VERSION, width, self.digest.digest()))
        self.at, self.tokens = _HEAD.size, 0
        self.entries: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.width == 2:
            if len(ids) and ids.max() > 0xFFFF:
                raise ValueError("an id needs more than two bytes")
            ids = ids.astype("<u2")
        frame = self.compressor.compress(ids.tobytes())
        self.sink.write(frame)
        self.at += len(frame)
        self.entries.append((self.at, self.tokens, doc_id or 0, doc_id is None))
        self.tokens += len(ids)

    def close(self) -> dict:
        index = np.array(self.entries, _ENTRY)
        raw = index.tobytes()
        self.sink.write(raw)
        self.sink.write(_TAIL.pack(self.at, len(index), zlib.crc32(raw), MAGIC))
        self.sink.close()
        known = index["doc_id"][index["no_id"] == 0]
        return {
            "name": self.name,
            "documents": len(index),
            "tokens": self.tokens,
            "bytes": self.at - _HEAD.size,
            "low": int(known.min()) if len(known) else None,
            "high": int(known.max()) if len(known) else None,
            "some_without_id": len(known) < len(index),
            "dictionary": self.digest.hexdigest(),
        }


_MANIFEST = pa.schema(
    [
        ("name", pa.string()),
        ("documents", pa.int64()),
        ("tokens", pa.int64()),
        ("bytes", pa.int64()),
        ("low", pa.int64()),
        ("high", pa.int64()),
        ("some_without_id", pa.bool_()),
        ("dictionary", pa.string()),
        ("start", pa.int64()),
    ]
)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.width = options["path"], int(options.get("width", 4))
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))
        if self.width not in (2, 4):
            raise ValueError("an id has 2 or 4 bytes")

    def write(self, iterator: Iterable[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        content = _read(self.path, "dictionary")
        dictionary = _zstd_dictionary(content)
        if dictionary:
            dictionary.precompute_compress(level=LEVEL)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        done = _Files(TaskContext.get().partitionId())
        now = None
        for batch in iterator:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                now = now or _OneFile(self.path, self.width, content, compressor)
                now.add(doc_id, np.frombuffer(ids.as_buffer() or b"", "<u4") if ids.is_valid else np.zeros(0, "<u4"))
                if now.at >= self.file_bytes:
                    done.rows.append(now.close())
                    now = None
        if now:
            done.rows.append(now.close())
        return done

    def commit(self, messages: list) -> None:
        rows, start = [], 0
        for message in sorted((m for m in messages if m), key=lambda m: m.partition):
            for row in message.rows:
                rows.append({**row, "start": start})
                start += row["tokens"]
        sink = io.BytesIO()
        pq.write_table(pa.Table.from_pylist(rows, _MANIFEST), sink)
        _write(self.path, "manifest.parquet", sink.getvalue())

    def abort(self, messages: list) -> None:
        system, base = _place(self.path)
        for message in messages:
            for row in message.rows if message else ():
                system.delete_file(f"{base}/{row['name']}")


@dataclass
class _Part(InputPartition):
    name: str
    start: int
    share: int
    shares: int
    dictionary: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        #: only these documents: files are picked by their smallest and largest id, frames by the index
        self.wanted = {int(i) for i in options["docids"].split(",")} if "docids" in options else None

    def partitions(self) -> list[InputPartition]:
        manifest = pq.read_table(io.BytesIO(_read(self.path, "manifest.parquet"))).to_pylist()
        out = []
        for row in manifest:
            if self.wanted is not None and not any(row["low"] is not None and row["low"] <= w <= row["high"] for w in self.wanted):
                continue
            shares = max(1, min(row["documents"], -(-row["bytes"] // READ_BYTES)))
            out += [_Part(row["name"], row["start"], k, shares, row["dictionary"]) for k in range(shares)]
        return out

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # of a folder without files
            return
        content = _read(self.path, "dictionary")
        if hashlib.sha256(content).hexdigest() != partition.dictionary:
            raise ValueError("the dictionary is not the one the file was written with")
        decompressor = zstandard.ZstdDecompressor(dict_data=_zstd_dictionary(content))
        system, base = _place(self.path)
        with system.open_input_file(f"{base}/{partition.name}") as source:
            size = source.size()
            width, index = _index(source, size)
            low, high = (len(index) * (partition.share + k) // partition.shares for k in (0, 1))
            begins = np.concatenate([[_HEAD.size], index["end"][:-1]]).astype(np.int64)
            picked = np.arange(low, high)
            if self.wanted is not None:
                picked = picked[np.isin(index["doc_id"][low:high], list(self.wanted)) & (index["no_id"][low:high] == 0)]
            at = 0
            while at < len(picked):
                # neighbours are read together, a document that stands alone by itself
                stop = at + 1
                first = begins[picked[at]]
                while stop < len(picked) and picked[stop] == picked[stop - 1] + 1 and index["end"][picked[stop]] - first <= BATCH_BYTES and stop - at < 1000:
                    stop += 1
                run = picked[at:stop]
                source.seek(int(first))
                raw = memoryview(source.read(int(index["end"][run[-1]] - first)))
                ids = []
                for k in run.tolist():
                    frame = raw[int(begins[k] - first) : int(index["end"][k] - first)]
                    ids.append(decompressor.decompress(frame))
                yield _batch(index[run], partition.start, ids, width)
                at = stop


def _index(source, size: int) -> tuple[int, np.ndarray]:
    source.seek(0)
    magic, version, width, _ = _HEAD.unpack(source.read(_HEAD.size))
    source.seek(size - _TAIL.size)
    place, count, check, end = _TAIL.unpack(source.read(_TAIL.size))
    if magic != MAGIC or end != MAGIC or version != VERSION:
        raise ValueError("not a complete file of token ids")
    source.seek(place)
    raw = source.read(count * _ENTRY.itemsize)
    if zlib.crc32(raw) != check:
        raise ValueError("the index is damaged")
    return width, np.frombuffer(raw, _ENTRY)


def _batch(entries: np.ndarray, start: int, ids: list[bytes], width: int) -> pa.RecordBatch:
    sizes = np.array([len(i) // width for i in ids], np.int64)
    if width == 2:
        ids = [np.frombuffer(i, "<u2").astype("<u4").tobytes() for i in ids]
    doc_ids = pa.array(entries["doc_id"].astype(np.int64), mask=entries["no_id"].astype(bool))
    starts = pa.array(entries["before"].astype(np.int64) + start)
    return pa.RecordBatch.from_arrays([doc_ids, starts, pa.array(sizes), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


class TokenFiles(DataSource):
    """``spark.read.format("token_ids").load(folder)`` and ``df.write.format("token_ids").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def token_rows(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids) with the end id behind the ids of each text; a null or empty text is the end id alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in batches:
            ids = [np.append(found, np.uint32(end_id)).astype("<u4").tobytes() for found in words.encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def _dictionary(docs: DataFrame, tokenizer: str, width: int) -> bytes:
    """Trained in one task on the bounded sample: the documents of the least text hashes among those that are short."""
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    short = short.filter(F.char_length("text").between(1, SAMPLE_CHARS))
    sample = short.orderBy(F.xxhash64("text"), "doc_id").limit(SAMPLE_DOCS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = []
        for batch in batches:
            samples += [np.frombuffer(i, "<u4").astype(f"<u{width}").tobytes() for i in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([train(samples)], pa.binary())], names=["dictionary"])

    rows = token_rows(sample, tokenizer).coalesce(1).mapInArrow(run, "dictionary binary").collect()
    return bytes(rows[0]["dictionary"]) if rows else b""


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, width: int = 4) -> None:
    """Write the token ids of (doc_id, text) below ``path``, a new folder that every executor reaches.

    Files follow each other by doc_id, nulls first; rows of one doc_id stay rows of their own, ordered by the hash of
    their text.  Other columns are ignored.  An empty table gives a manifest without files.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    _write(path, "dictionary", _dictionary(docs, tokenizer, width))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    with small_batches(spark):
        token_rows(ranged, tokenizer, end_id).write.format(FORMAT).mode("append").option("width", width).save(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files below ``path``; ``start`` counts the ids of all documents before.

    With ``doc_ids`` only the frames of those documents are read and decompressed.
    """
    spark.dataSource.register(TokenFiles)
    reader = spark.read.format(FORMAT)
    if doc_ids:
        reader = reader.option("docids", ",".join(str(int(i)) for i in doc_ids))
    return reader.load(path)
