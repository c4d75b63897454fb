"""Derivatives of web archives: every response record gives a metadata and a plain-text conversion record.

Records are rows; headers and blocks are strings built from columns.  A derived record refers to its response by record
id, carries the response's target, date, status line, headers and digests, and has an id that follows from the
response's id and its own type, so a repeated run writes the same records.  Records are written uncompressed as WARC/1.1
by Spark's text sink.  Archives are read record by record as bytes, plain or as gzip members, and payloads are decoded by
their own charsets.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.pagetext import PageText

VERSION = "WARC/1.1"
CRLF = "\r\n"
SEPARATOR = CRLF + CRLF
_FIELDS = "application/warc-fields"
LINE_LIMIT = 1 << 20  # a header line that is longer is read in pieces
BATCH_BYTES = 32 << 20
_NO_TEXT = re.compile(r"(image|audio|video|font)/|application/(octet-stream|zip|gzip|x-gzip|pdf|x-tar)\b")
_MARKED = {b"\xef\xbb\xbf": "utf-8-sig", b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16"}
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest(block: Column) -> Column:
    """``sha1:`` and the SHA-1 of the UTF-8 bytes in base 32: forty hexadecimal digits are eight groups of 20 bits."""
    hexed = F.sha1(block.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*groups), _HEX32, _BASE32))


def record_uri(*parts: Column) -> Column:
    """A record id that follows from the parts, in the form of a name-based UUID."""
    h = F.sha1(F.concat_ws("\u0000", *parts).cast("binary"))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    dashed = F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def _one_line(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"[\r\n\t ]++", " "))


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response rows of a page table (page_id, url, html): page_id, record_id, target_uri, date, http, payload, digests.

    ``http`` has the status line and the headers, lines end with CRLF.  A null page is an empty payload; a null url
    stays null and is then no header.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(CRLF),
    )
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        record_uri(F.lit("response"), F.col("page_id").cast("string"), F.col("url").cast("string"), body).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.lit(date).alias("date"),
        http.alias("http"),
        body.alias("payload"),
    )
    return with_digests(rows)


def with_digests(rows: DataFrame) -> DataFrame:
    block = F.concat(F.col("http"), F.lit(CRLF), F.col("payload"))
    return rows.withColumn("payload_digest", digest(F.col("payload"))).withColumn("block_digest", digest(block))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), _one_line(value), F.lit(CRLF)), F.lit(""))


def _fields(name: str, values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.concat(F.lit(f"{name}: "), _one_line(v), F.lit(CRLF))), "")


def _headers(name: str, pairs: Column) -> Column:
    return _fields(name, F.transform(F.coalesce(pairs, F.array()), lambda p: F.concat_ws(": ", p["name"], p["value"])))


def derive(responses: DataFrame) -> DataFrame:
    """Two rows per response: record_type, record_id, refers_to, target_uri, date, content_type, source fields, block.

    The metadata block lists title, description, keywords, the status line and every header of the response, its
    digests, the id of the conversion, and the links of the page in order.  If the responses have ``warc_headers`` and
    ``whole``, it also lists every header of the source record, and that the source is cut.  The conversion block is the page as plain
    text.  ``concurrent_to`` links the two.  All columns of ``responses`` but those named here are kept as they are if
    their names do not clash with a result's.
    """
    made = ["record_type", "record_id", "refers_to", "concurrent_to", "content_type", "block", "content_length", "source_http"]
    kept = [c for c in responses.columns if c not in (*made, "block_digest", "source_block_digest", "http", "payload")]
    source = responses.select(
        *kept,
        F.col("record_id").alias("refers_to"),
        F.col("block_digest").alias("source_block_digest"),
        F.col("http").alias("source_http"),
        F.col("payload").alias("_payload"),
    )
    read = [f for f in source.schema if f.name != "_payload"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read)
    paged = source.mapInArrow(
        _read_pages, f"{fields}, _title string, _description string, _keywords string, _links array<string>, _content string"
    )
    lines = F.filter(F.split("source_http", CRLF, -1), lambda line: line != "")
    conversion = record_uri(F.lit("conversion"), F.col("refers_to"))
    metadata = record_uri(F.lit("metadata"), F.col("refers_to"))
    facts = F.concat(
        _field("title", F.col("_title")),
        _field("description", F.col("_description")),
        _field("keywords", F.col("_keywords")),
        _field("source-status", F.get(lines, F.lit(0))),
        _fields("source-header", F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))),
        _field("source-payload-digest", F.col("payload_digest")),
        _field("source-block-digest", F.col("source_block_digest")),
        *([_headers("source-warc-header", F.col("warc_headers"))] if "warc_headers" in kept else []),
        *([_field("source-truncated", F.when(~F.col("whole"), "unspecified"))] if "whole" in kept else []),
        _field("conversion", conversion),
        _fields("outlink", F.col("_links")),
    )

    def record(kind: str, own: Column, other: Column, content: str, block: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("record_type"),
            own.alias("record_id"),
            other.alias("concurrent_to"),
            F.lit(content).alias("content_type"),
            block.alias("block"),
        )

    both = F.array(
        record("metadata", metadata, conversion, _FIELDS, facts),
        record("conversion", conversion, metadata, "text/plain; charset=utf-8", F.col("_content")),
    )
    out = paged.select(*[c for c in kept if c != "record_id"], "refers_to", "source_block_digest", "source_http", F.inline(both))
    return out.withColumn("content_length", F.octet_length("block").cast("long")).withColumn("block_digest", digest(F.col("block")))


def _read_pages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [PageText(html or "") for html in batch.column("_payload").to_pylist()]
        kept = batch.drop_columns(["_payload"])
        yield pa.RecordBatch.from_arrays(
            [
                *kept.columns,
                pa.array([p.title for p in pages], pa.string()),
                pa.array([p.metas.get("description") for p in pages], pa.string()),
                pa.array([p.metas.get("keywords") for p in pages], pa.string()),
                pa.array([p.links for p in pages], pa.list_(pa.string())),
                pa.array([p.text for p in pages], pa.string()),
            ],
            names=[*kept.schema.names, "_title", "_description", "_keywords", "_links", "_content"],
        )


def record_text(rows: DataFrame) -> Column:
    """The record of a derived row up to the end of its block."""
    named = {
        "WARC-Type": "record_type",
        "WARC-Record-ID": "record_id",
        "WARC-Refers-To": "refers_to",
        "WARC-Concurrent-To": "concurrent_to",
        "WARC-Target-URI": "target_uri",
        "WARC-Date": "date",
        "WARC-Payload-Digest": "payload_digest",
        "WARC-Block-Digest": "block_digest",
        "Content-Type": "content_type",
        "Content-Length": "content_length",
    }
    # the source's payload digest belongs to the response; a derived record states its own block only
    skipped = () if "http" in rows.columns else ("WARC-Payload-Digest",)
    heads = [_field(k, F.col(c).cast("string")) for k, c in named.items() if c in rows.columns and k not in skipped]
    return F.concat(F.lit(VERSION + CRLF), *heads, F.lit(CRLF), F.col("block"))


def response_records(responses: DataFrame) -> DataFrame:
    """Rows that ``write_warc`` can write, of response rows."""
    block = F.concat(F.col("http"), F.lit(CRLF), F.col("payload"))
    return responses.withColumns(
        {
            "record_type": F.lit("response"),
            "content_type": F.lit("application/http; msgtype=response"),
            "block": block,
            "content_length": F.octet_length(block).cast("long"),
        }
    )


def write_warc(rows: DataFrame, path: str) -> None:
    """One WARC file per partition; each record ends with two line breaks."""
    rows.select(record_text(rows).alias("value")).write.option("lineSep", SEPARATOR).text(path)


class _Feed:
    """A binary stream that takes bytes back."""

    def __init__(self, raw: io.BufferedIOBase):
        self.raw, self.back = raw, io.BytesIO()

    def give_back(self, data: bytes) -> None:
        self.back = io.BytesIO(data + self.back.read())

    def readline(self) -> bytes:
        line = self.back.readline()
        try:
            return line if line.endswith(b"\n") else line + self.raw.readline(LINE_LIMIT)
        except EOFError:  # an archive that ends inside a gzip member
            return line

    def read(self, n: int) -> bytes:
        parts = [self.back.read(n)]
        left = n - len(parts[0])
        try:
            while left > 0 and (part := self.raw.read(min(left, 1 << 20))):
                parts.append(part)
                left -= len(part)
        except EOFError:
            pass
        return b"".join(parts)


def _fields_of(feed: _Feed) -> list[tuple[str, str]]:
    """Header lines up to the empty one; a folded line goes on in the next."""
    fields: list[tuple[str, str]] = []
    while (line := feed.readline()).strip(b"\r\n"):
        text = line.decode("utf-8", "replace").strip()
        if line[:1] in b" \t" and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {text}")
        else:
            name, _, value = text.partition(":")
            fields.append((name.rstrip(), value.lstrip()))
    return fields


def records_of(raw: io.BufferedIOBase) -> Iterator[tuple[list[tuple[str, str]], bytes, bool]]:
    """(fields, block, whole) of the records of an uncompressed stream.

    A block has the stated length and may hold anything.  If no end of a record follows it, or no valid length is
    stated, the length is wrong: the block then ends before the next version line that follows an end of a record.
    """
    feed = _Feed(raw)
    line = feed.readline()
    while line:
        if not line.startswith(b"WARC/"):
            line = feed.readline()
            continue
        fields = _fields_of(feed)
        stated = next((v for k, v in fields if k.lower() == "content-length"), "")
        length = int(stated) if stated.isascii() and stated.isdigit() else 0
        block = feed.read(length)
        line = feed.readline()
        whole = stated.isascii() and stated.isdigit() and len(block) == length and not line.strip()
        if not whole:
            held = block + line
            cut = held.find(SEPARATOR.encode() + b"WARC/1.")
            if cut >= 0:  # the stated length reaches into the next record
                feed.give_back(held[cut + 4 :])
                block, line = held[:cut], feed.readline()
            else:
                parts, tail = [held], held[-4:]
                while (line := feed.readline()) and not (line.startswith(b"WARC/1.") and tail == b"\r\n\r\n"):
                    parts.append(line)
                    tail = (tail + line)[-4:]
                block = b"".join(parts).removesuffix(b"\r\n\r\n")
        yield fields, block, whole


def _open(path: str) -> io.BufferedIOBase:
    """The file's records, decompressed if it is a chain of gzip members."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    raw = io.BufferedReader(system.open_input_stream(name, compression=None), 1 << 20)
    return gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


_RECORD = pa.schema(
    [
        ("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
        ("block", pa.binary()),
        ("whole", pa.bool_()),
    ]
)


def _read_files(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows, size = [], 0
            with _open(path) as stream:
                for fields, block, whole in records_of(stream):
                    rows.append({"fields": [{"name": k, "value": v} for k, v in fields], "block": block, "whole": whole})
                    size += len(block)
                    if size >= BATCH_BYTES or len(rows) >= 1000:
                        yield made(rows)
                        rows, size = [], 0
            yield made(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(headers, fields, block, whole) of every record of the files below ``path``, WARC/1.0 or 1.1, plain or gzip.

    ``block`` is binary.  ``fields`` has the headers as (name, value) in order, repeated ones included; ``headers`` maps
    lower-cased names to their first values.  ``whole`` is false if a block has not the stated length, as at a cut end
    of a file, so such records are seen, not lost.  A file is one task's work: its records pass in batches, and at most
    one block (below 2 GB) and one batch are held.
    """
    # Spark lists the files; their contents are not read by its source
    paths = spark.read.format("binaryFile").load(path).select("path")
    rows = paths.mapInArrow(_read_files, "fields array<struct<name: string, value: string>>, block binary, whole boolean")
    names = F.transform("fields", lambda f: F.lower(f["name"]))
    entries = F.transform("fields", lambda f: F.struct(F.lower(f["name"]).alias("key"), f["value"].alias("value")))
    first = F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1)
    return rows.select(F.map_from_entries(first).alias("headers"), "fields", "block", "whole")


def _dechunked(data: bytes) -> bytes:
    """The content of a chunked transfer, or the bytes as they are if they are none."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
            return data
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n
        if data[at : at + 2] != b"\r\n":
            return data
        at += 2


def _unpacked(data: bytes) -> bytes:
    """The content of a gzip or zlib stream, what can be read of it; other bytes as they are."""
    if data[:2] != b"\x1f\x8b" and (len(data) < 2 or data[0] & 15 != 8 or int.from_bytes(data[:2], "big") % 31):
        return data
    try:
        return zlib.decompressobj(47).decompress(data)
    except zlib.error:
        return data


def _codec(name: str) -> str | None:
    """The name of a known text encoding; latin-1 means windows-1252 on the web."""
    try:
        found = codecs.lookup(name)
    except (LookupError, ValueError):
        return None
    if not found._is_text_encoding:
        return None
    return "cp1252" if found.name in ("iso8859-1", "ascii") else found.name


def decoded(http: str, payload: bytes) -> tuple[str, str | None]:
    """The payload as text and its charset: that of the HTTP header, of a byte order mark, of a meta tag, or UTF-8.

    Transfer and content encodings are undone first.  Pictures, sounds and packed files are no text: empty, null.
    Bytes that the charset does not know become replacement characters.
    """
    heads = {}
    for line in http.split("\r\n")[1:]:
        name, _, value = line.partition(":")
        heads.setdefault(name.strip().lower(), value.strip())
    kind = heads.get("content-type", "").lower()
    if _NO_TEXT.match(kind):
        return "", None
    if "chunked" in heads.get("transfer-encoding", "").lower():
        payload = _dechunked(payload)
    if heads.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        payload = _unpacked(payload)
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind)
    marks = [c for mark, c in _MARKED.items() if payload.startswith(mark)]
    inside = re.search(rb"<meta[^>]{0,400}?charset\s*=\s*[\"']?\s*([\w.:-]+)", payload[:4096], re.IGNORECASE)
    asked = [*marks, named and named[1], inside and inside[1].decode("ascii", "replace")]
    codec = next((c for c in (_codec(a) for a in asked if a) if c), "utf-8")
    return payload.decode(codec, "replace"), codec


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _read_responses(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made: dict[str, list] = {"http": [], "payload": [], "charset": [], "own_payload": [], "own_block": []}
        for block, kind, whole in zip(*[batch.column(c).to_pylist() for c in ("block", "kind", "whole")]):
            block = block or b""
            head, gap, body = block.partition(b"\r\n\r\n")
            if not (kind or "application/http").lower().startswith("application/http"):
                http, body = "", block
                text, charset = decoded(f"\r\ncontent-type: {kind}", body)
            else:
                http = (head + (b"\r\n" if gap else b"")).decode("latin-1")
                text, charset = decoded(http, body)
            digests = (_sha1(body), _sha1(block)) if whole else (None, None)
            for name, value in zip(made, (http, text, charset, *digests)):
                made[name].append(value)
        kept = batch.drop_columns(["block", "kind"])
        arrays = [pa.array(v, pa.string()) for v in made.values()]
        yield pa.RecordBatch.from_arrays([*kept.columns, *arrays], names=[*kept.schema.names, *made])


def responses_of_records(records: DataFrame) -> DataFrame:
    """Response rows (record_id, target_uri, date, http, payload, charset, digests, warc_headers, whole) of records that
    ``read_warc`` gave.

    ``payload`` is the decoded text (see ``decoded``); digests are those of the bytes.  Declared digests are kept as
    they stand; an absent one is computed if the block is whole and else null.  ``warc_headers`` has all headers of the
    record in order.  A response that is not HTTP is all payload.
    """
    head = F.col("headers")
    rows = records.filter(F.lower(head["warc-type"]) == "response").select(
        head["warc-record-id"].alias("record_id"),
        head["warc-target-uri"].alias("target_uri"),
        head["warc-date"].alias("date"),
        F.col("fields").alias("warc_headers"),
        "whole",
        head["warc-payload-digest"].alias("payload_digest"),
        head["warc-block-digest"].alias("block_digest"),
        F.col("block"),
        head["content-type"].alias("kind"),
    )
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("block", "kind"))
    read = rows.mapInArrow(_read_responses, f"{kept}, http string, payload string, charset string, own_payload string, own_block string")
    return read.select(
        "record_id", "target_uri", "date", "http", "payload", "charset", "warc_headers", "whole",
        F.coalesce("payload_digest", "own_payload").alias("payload_digest"),
        F.coalesce("block_digest", "own_block").alias("block_digest"),
    )
