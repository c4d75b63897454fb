"""Places of terms packed in blocks: many postings in a row, their numbers as bytes.

A block has the documents of one segment with one term.  ``docs`` has a pair of numbers per document, the step from the
last document's number and how often the term is there; ``places`` has a pair per place, the step in position and what
the step in characters has beyond ``STEP`` per position.  Numbers take seven bits a byte, so most take one or two.  All
functions work on whole Arrow batches.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

SEGMENT_DOCS = 4096  # documents of a segment, at most
STEP = 6  # characters from a term to the next, about
KIND = "segment bigint, field string, term string, n int, docs binary, places binary"
NAMES = ["segment", "field", "term", "n", "docs", "places"]


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of numbers from 0, and how many each takes."""
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        more = values >= 1 << bits
        if not more.any():
            break
        sizes += more
    begins = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    for at in range(int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > at)
        out[begins[some] + at] = (values[some] >> 7 * at & 127) | np.where(sizes[some] > at + 1, 128, 0)
    return out, sizes


def unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.flatnonzero(data < 128) + 1
    sizes = np.diff(ends, prepend=0)
    begins, values = ends - sizes, np.zeros(len(ends), np.int64)
    for at in range(int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > at)
        values[some] |= (data[begins[some] + at] & 127).astype(np.int64) << 7 * at
    return values, sizes


def _steps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences from the value before; the rows of ``first`` begin anew from 0."""
    steps = np.diff(values, prepend=0)
    steps[first] = values[first]
    return steps


def _sums(steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What ``_steps`` was made of."""
    sums = np.cumsum(steps)
    return sums - np.repeat(sums[first] - steps[first], np.diff(first, append=len(steps)))


def _begins(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


def _pack_docs(no: np.ndarray, tf: np.ndarray, n: np.ndarray) -> pa.Array:
    data, sizes = packed(np.column_stack([_steps(no, _begins(n)), tf]).ravel())
    return _binary(data, np.add.reduceat(sizes, 2 * _begins(n)) if len(n) else sizes)


def _pack_places(pos: np.ndarray, start: np.ndarray, tf: np.ndarray, n: np.ndarray) -> pa.Array:
    first = _begins(tf)
    step = _steps(pos, first)
    rest = _steps(start, first) - STEP * step
    data, sizes = packed(np.column_stack([step, np.where(rest < 0, -2 * rest - 1, 2 * rest)]).ravel())
    return _binary(data, np.add.reduceat(sizes, 2 * first[_begins(n)]) if len(n) else sizes)


def _documents(n: np.ndarray, docs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number and count of each posting of some blocks."""
    pairs = unpacked(_bytes(docs))[0].reshape(-1, 2)
    return _sums(pairs[:, 0], _begins(n)), pairs[:, 1]


def place_blocks(fields: Sequence[str], stop_words: Iterable[str] = tx.STOP_WORDS, first: int = 0) -> Callable:
    """For ``mapInArrow`` of (_id, a list of texts per field): rows (*NAMES, ids, lengths), terms as ``text.terms`` has them.

    A segment has up to ``SEGMENT_DOCS`` documents, numbered from 0, and a number that no other task has: ``first``, the
    partition and a counter.  A block has up to ``text.BLOCK_DOCS`` of them, n.  A row without a term has the ids and
    lengths of the segment's documents.  The texts of a list count as one.
    """
    fields, left_out = tuple(fields), pa.array([*stop_words], pa.string())

    def counted(segment: int, ids: pa.Array, field: str, column: pa.Array) -> pa.RecordBatch:
        docs, per_doc = len(ids), column.value_lengths().to_numpy(zero_copy_only=False)
        text, pos, start, terms = tx.located([(t or "").lower() for t in column.flatten().to_pylist()])
        row, coded = np.repeat(np.arange(docs), per_doc)[text], terms.dictionary_encode()
        code = coded.indices.to_numpy()
        wanted = pc.invert(pc.is_in(coded.dictionary, left_out)).to_numpy(zero_copy_only=False)[code]
        code, row, pos, start = code[wanted].astype(np.int64), row[wanted], pos[wanted], start[wanted]
        length = np.bincount(row, minlength=docs).astype(np.int32)
        pair = code * docs + row
        order = np.argsort(pair, kind="stable") if (per_doc <= 1).all() else np.lexsort((start, pos, pair))
        pair, pos, start = pair[order], pos[order], start[order]
        places = np.flatnonzero(np.diff(pair, prepend=-1))
        code, row, tf = pair[places] // docs, pair[places] % docs, np.diff(places, append=len(pair))
        begin = np.flatnonzero(np.diff(code, prepend=-1))
        at = np.arange(len(code)) - np.repeat(begin, np.diff(begin, append=len(code)))
        begins = np.flatnonzero(at % tx.BLOCK_DOCS == 0)
        n, blocks = np.diff(begins, append=len(code)), len(begins)
        whole = [pa.ListArray.from_arrays(pa.array([0, docs], pa.int32()), part) for part in (ids, pa.array(length))]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(blocks + 1, segment, np.int64)),
                pa.array([field] * (blocks + 1), pa.string()),
                pa.concat_arrays([coded.dictionary.take(pa.array(code[begins])), pa.nulls(1, pa.string())]),
                pa.array(np.append(n, docs).astype(np.int32)),
                *[pa.concat_arrays([part, pa.nulls(1, pa.binary())]) for part in (_pack_docs(row, tf, n), _pack_places(pos, start, tf, n))],
                *[pa.concat_arrays([pa.nulls(blocks, part.type), part]) for part in whole],
            ],
            names=[*NAMES, "ids", "lengths"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        segment = first + ((0 if task is None else task.partitionId()) << 20)
        for piece in tx.text_pieces(batches, SEGMENT_DOCS):
            piece = piece.combine_chunks()
            ids, *texts = (column.chunk(0) for column in piece.columns)
            for field, column in zip(fields, texts):
                yield counted(segment, ids, field, column)
            segment += 1

    return run


def documents(n: Column, docs: Column) -> Column:
    """``array<struct<no, tf>>`` of a block."""

    @F.arrow_udf("array<struct<no:int,tf:bigint>>")
    def unfold(n: pa.Array, docs: pa.Array) -> pa.Array:
        n = n.to_numpy(zero_copy_only=False).astype(np.int64)
        no, tf = _documents(n, docs)
        rows = pa.StructArray.from_arrays([pa.array(no.astype(np.int32)), pa.array(tf)], names=["no", "tf"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), rows)

    return unfold(n, docs)


def postings(term: Column, n: Column, docs: Column, places: Column) -> Column:
    """``array<struct<no, tf, places<pos, start, end>>>`` of a block; a place ends where its term does."""

    @F.arrow_udf("array<struct<no:int,tf:bigint,places:array<struct<pos:int,start:int,end:int>>>>")
    def unfold(term: pa.Array, n: pa.Array, docs: pa.Array, places: pa.Array) -> pa.Array:
        n = n.to_numpy(zero_copy_only=False).astype(np.int64)
        no, tf = _documents(n, docs)
        pairs, first = unpacked(_bytes(places))[0].reshape(-1, 2), _begins(tf)
        rest = np.where(pairs[:, 1] & 1, -(pairs[:, 1] + 1 >> 1), pairs[:, 1] >> 1)
        pos, start = _sums(pairs[:, 0], first), _sums(rest + STEP * pairs[:, 0], first)
        size = np.repeat(np.repeat(pc.utf8_length(term).to_numpy(zero_copy_only=False), n), tf)
        each = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in (pos, start, start + size)], names=["pos", "start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf)).astype(np.int32)), each)
        rows = pa.StructArray.from_arrays([pa.array(no.astype(np.int32)), pa.array(tf), lists], names=["no", "tf", "places"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), rows)

    return unfold(term, n, docs, places)


def _marks_at(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the segments of a stored table (segment, no), in order, and a bit per document of each, as a byte here."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))
    segments, bits = [], []
    for batch in ds.dataset(place, filesystem=system, format="parquet").to_batches(columns=["segment", "bits"]):
        segments.append(batch.column("segment").to_numpy(zero_copy_only=False))
        bits += batch.column("bits").to_pylist()
    segments = np.concatenate([*segments, np.zeros(0, np.int64)])
    held = np.zeros((len(bits), SEGMENT_DOCS // 8), np.uint8)
    for row, found in enumerate(bits):
        held[row, : len(found)] = np.frombuffer(found, np.uint8)
    order = np.argsort(segments)
    return segments[order], held[order]


def _marked(marks: tuple[np.ndarray, np.ndarray], batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Size of each block, number and count of each posting, and if its document is marked."""
    segments, bits = marks
    n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
    no, tf = _documents(n, batch.column("docs"))
    segment = batch.column("segment").to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(segments, segment), len(segments) - 1)
    row = np.repeat(at, n)
    return n, no, tf, (bits[row, no >> 3] >> (no & 7) & 1).astype(bool) & np.repeat(segments[at] == segment, n)


def marked_counts(path: str) -> Callable:
    """For ``mapInArrow`` of blocks: rows (field, term, df), the marked documents of each block that has any, below zero."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _marks_at(path)
        for batch in batches:
            if batch.num_rows and len(marks[0]):
                n, _, _, marked = _marked(marks, batch)
                df = np.add.reduceat(marked.astype(np.int64), _begins(n))
                some = pa.array(np.flatnonzero(df))
                yield pa.RecordBatch.from_arrays([batch.column("field").take(some), batch.column("term").take(some), pa.array(-df[df > 0])], names=["field", "term", "df"])

    return run


def without_marked(path: str) -> Callable:
    """For ``mapInArrow`` of blocks: the blocks without the marked documents, empty ones left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _marks_at(path)
        for batch in batches:
            if not batch.num_rows or not len(marks[0]):
                yield batch
                continue
            n, no, tf, marked = _marked(marks, batch)
            if not marked.any():
                yield batch
                continue
            left = np.add.reduceat((~marked).astype(np.int64), _begins(n))
            rows, some = pa.array(np.flatnonzero(left)), left[left > 0]
            data = _bytes(batch.column("places"))
            sizes = unpacked(data)[1]
            per_posting = np.add.reduceat(sizes, 2 * _begins(tf))
            kept = np.where(marked, 0, per_posting)
            places = _binary(data[np.repeat(~marked, per_posting)], np.add.reduceat(kept, _begins(n))[left > 0])
            columns = [batch.column(c).take(rows) for c in ("segment", "field", "term")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(some.astype(np.int32)), _pack_docs(no[~marked], tf[~marked], some), places], names=NAMES)

    return run
