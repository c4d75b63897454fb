"""Token sequences of bounded length, filled by bulk-synchronous best fit.

Texts become token ids, a text's ids and an end id are cut into pieces of at most ``capacity`` ids, and pieces are
packed whole.  Only (piece, length) rows take part in the packing.

A round takes the unplaced pieces and the gaps of the open sequences, sorts both by size over range partitions, and
sweeps each range from large to small: a piece takes the smallest gap that holds it, and what is left of the gap stays
in the sweep as long as it can hold a piece of the range.  Pieces that found no gap in their range and gaps left over
get ranks inside their size class of the range; runs of ranks are matched with the nearest larger gaps of other ranges
from the counts per class alone, several pieces to one gap if they fit.  Then gaps are updated and the next round starts.
When a round places little, the largest unplaced pieces open new sequences, as many as their volume needs.

The driver sees one row of counts per range partition and size class (``CLASSES`` per doubling of the size), however
many pieces there are.  A sequence holds at most ``capacity`` pieces.
"""

from __future__ import annotations

import bisect
import math
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.wordhash import text_bytes, word_hashes
from corpusloom.llm.work import lean, store

CAPACITY = 4096
END_ID = 1
CACHE_PARTS = 1_000_000
MAX_ROUNDS = 500
FILE_ROWS = 1 << 32
CLASSES = 8
LITTLE = 0.05  # share of the unplaced volume; a round that places less opens sequences


_CLASS = np.full(256, 4, np.uint8)  # not ASCII, and control characters
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_APOSTROPHE = ord("'")


def _safe_parts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bytes before which a word of this tokenizer kind may be cut: between ASCII letters, digits and marks.

    Letters, digits and runs of marks are tokens of their own, but for a contraction with an apostrophe; a word that has
    one stays whole.  Nothing is cut next to other characters, which may combine or count as marks.
    """
    kind = _CLASS[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = (kind[1:] != kind[:-1]) & (kind[1:] < 4) & (kind[:-1] < 4)
    marks = np.flatnonzero(data == _APOSTROPHE)
    if len(marks) and first.any():
        word = np.cumsum(first) - 1
        whole = np.zeros(int(word[-1]) + 2, bool)
        whole[word[marks]] = True
        cut &= ~whole[word]
    return cut


class WordTokenizer:
    """Ids of texts from the ids of their words' parts, for a tokenizer that lower-cases, drops white space, and takes
    runs of letters, single digits and runs of marks as its words.

    Parts are told apart by a 64-bit hash of their lower-case bytes.  The ids of seen parts are kept in sorted arrays, up
    to ``CACHE_PARTS`` of them per worker.  A text that spells one of the tokenizer's special tokens is encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.heads, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, starts: np.ndarray, stops: np.ndarray, data: np.ndarray) -> None:
        """Add the ids of new parts; ``keys`` are sorted and not known."""
        if len(self.keys) + len(keys) > CACHE_PARTS:
            raise OverflowError
        ids: list[int] = []
        sizes = np.zeros(len(keys), np.int64)
        for at in range(0, len(keys), 8192):
            spans = zip(starts[at : at + 8192].tolist(), stops[at : at + 8192].tolist())
            words = [data[a:b].tobytes() for a, b in spans]
            # the same bytes in another case may be ordinary text, and texts with special tokens are encoded whole
            words = [(w.upper() if any(t in w for t in self.special) else w).decode() for w in words]
            for k, got in enumerate(self.tokenizer.encode_batch_fast(words, add_special_tokens=False), at):
                sizes[k] = len(got.ids)
                ids += got.ids
        places = np.searchsorted(self.keys, keys)
        self.heads = np.insert(self.heads, places, np.cumsum(sizes) - sizes + len(self.flat))
        self.sizes = np.insert(self.sizes, places, sizes)
        self.keys = np.insert(self.keys, places, keys)
        self.flat = np.concatenate([self.flat, np.array(ids, np.uint32)])

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, without an end id; a null text has none."""
        data, ends = text_bytes(column)
        raw = data.tobytes()
        special = any(t in raw for t in self.special)
        for at, counts, hashes, starts, stops in word_hashes(data, ends, parts=_safe_parts):
            keys, first, places = np.unique(hashes, return_index=True, return_inverse=True)
            known = np.searchsorted(self.keys, keys)
            known[known == len(self.keys)] = 0
            missing = self.keys[known] != keys if len(self.keys) else np.ones(len(keys), bool)
            if missing.any():
                try:
                    self._learn(keys[missing], starts[first[missing]], stops[first[missing]], data)
                except OverflowError:
                    self._forget()
                    self._learn(keys, starts[first], stops[first], data) if len(keys) <= CACHE_PARTS else None
            if len(keys) > CACHE_PARTS:  # one text with more different parts than are kept
                for low, high in zip(ends[at : at + len(counts)].tolist(), ends[at + 1 : at + len(counts) + 1].tolist()):
                    yield self._whole(raw[low:high])
                continue
            known = np.searchsorted(self.keys, keys)[places]
            sizes = self.sizes[known]
            stop = np.cumsum(sizes)
            total = int(stop[-1]) if len(stop) else 0
            ids = self.flat[np.repeat(self.heads[known] - (stop - sizes), sizes) + np.arange(total)]
            edges = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(counts)])]
            for k, (low, high) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist()), at):
                own = raw[ends[k] : ends[k + 1]] if special else b""
                yield self._whole(own) if special and any(t in own for t in self.special) else ids[low:high]

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)


_ENCODERS: dict[str, WordTokenizer] = {}


def encoder(path: str) -> WordTokenizer:
    """One tokenizer per worker process, so that tasks share what it has learned."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordTokenizer(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, order: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document; ids as little-endian unsigned 32-bit values.

    Only what is longer than ``capacity`` is cut, into full pieces and a last one.  A null or empty text is the end id
    alone.  A row that repeats another is a document of its own.  If ``order`` names a column of whole numbers, pieces
    have it as ``position``.
    """
    kept = ["doc_id"] if order is None else ["doc_id", "position"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in batches:
            rows, number, start, length, ids = [], [], [], [], []
            for row, found in enumerate(words.encode(batch.column("text"))):
                whole = np.append(found, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(whole), capacity)):
                    part = whole[at : at + capacity]
                    rows.append(row)
                    number.append(k)
                    start.append(at)
                    length.append(len(part))
                    ids.append(part.tobytes())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *[pc.take(batch.column(c), take) for c in kept],
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=[*kept, "piece", "start", "length", "ids"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.col(c).cast("long").alias("position") for c in [order] if c is not None],
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(lean(run), ", ".join(f"{c} long" for c in kept) + ", piece int, start long, length long, ids binary")


def _class_of(sizes: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(sizes, 1)) * CLASSES).astype(np.int32)


def _sweep(sizes: list[int], gaps: list[int]) -> tuple[list[tuple[int, int] | None], list[int]]:
    """One range: pieces from large to small.  For each the gap's number and size before, or None; the gaps after."""
    lowest = sizes[-1] if sizes else 0
    order = sorted((size, k) for k, size in enumerate(gaps))
    left = list(gaps)
    found: list[tuple[int, int] | None] = []
    for size in sizes:
        at = bisect.bisect_left(order, (size, -1))
        if at == len(order):
            found.append(None)
            continue
        have, k = order.pop(at)
        found.append((k, have))
        left[k] = have - size
        if left[k] >= lowest:
            bisect.insort(order, (left[k], k))
    return found, left


_STATE = "kind int, id long, size int"
_SWEPT = "part int, kind int, id long, size int, class int, seq long, before int, rank long"
PIECE, GAP = 1, 0


def _ranks(classes: np.ndarray) -> np.ndarray:
    """Positions inside runs of equal classes."""
    at = np.arange(len(classes))
    starts = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]]) if len(classes) else at
    return at - np.repeat(starts, np.diff(np.r_[starts, len(classes)]))


def _sweep_range(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of one range partition: pieces with their sequence, or with a rank in their class if they found none;
    gaps with the size that is left and a rank in its class."""
    from pyspark import TaskContext

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    kind, ids, size = (rows[c].to_numpy() for c in ("kind", "id", "size"))
    items, gaps = np.flatnonzero(kind == PIECE), np.flatnonzero(kind == GAP)
    items = items[np.lexsort((ids[items], -size[items]))]
    found, left = _sweep(size[items].tolist(), size[gaps].tolist())
    seq = [None if f is None else int(ids[gaps[f[0]]]) for f in found]
    before = [None if f is None else f[1] for f in found]
    unplaced = np.array([f is None for f in found], bool)
    ranks = np.full(len(items), -1, np.int64)
    ranks[unplaced] = _ranks(_class_of(size[items[unplaced]]))
    after = np.array(left, np.int64)
    order = np.lexsort((ids[gaps], -after))
    after = after[order]
    sizes = np.concatenate([size[items], after]).astype(np.int32)
    total = len(sizes)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(total, TaskContext.get().partitionId(), np.int32)),
            pa.array(np.repeat(np.array([PIECE, GAP], np.int32), [len(items), len(gaps)])),
            pa.array(np.concatenate([ids[items], ids[gaps[order]]])),
            pa.array(sizes),
            pa.array(_class_of(sizes)),
            pa.array(seq + [None] * len(gaps), pa.int64()),
            pa.array(before + [None] * len(gaps), pa.int32()),
            pa.array(np.concatenate([ranks, _ranks(_class_of(after))])),
        ],
        names=["part", "kind", "id", "size", "class", "seq", "before", "rank"],
    )


def _match(counts: list) -> tuple[list[tuple], list[tuple]]:
    """Runs of ranks (part, class, first rank, pieces, gap part, gap class, first gap rank, pieces per gap), and the
    piece segments (part, class, first rank, pieces, volume per piece) that are left over, from large to small.

    ``counts`` has rows (part, kind, class, n, low, high, volume): sizes of the unplaced pieces and left-over gaps.
    The pieces go from large to small; each takes the gaps of the smallest class that surely holds it.
    """
    gaps = sorted([c["low"], c["part"], c["class"], 0, c["n"]] for c in counts if c["kind"] == GAP and c["low"] > 0)
    runs, rest = [], []
    for c in sorted((c for c in counts if c["kind"] == PIECE), key=lambda c: (-c["high"], c["part"])):
        first, many = 0, c["n"]
        at = bisect.bisect_left(gaps, [c["high"]])
        while many and at < len(gaps):
            low, part, group, rank, have = gaps[at]
            slots = low // c["high"]
            use = min(have, math.ceil(many / slots))
            taken = min(many, use * slots)
            runs.append((c["part"], c["class"], first, taken, part, group, rank, slots))
            first, many = first + taken, many - taken
            if use == have:
                gaps.pop(at)
            else:
                gaps[at] = [low, part, group, rank + use, have - use]
        if many:
            rest.append((c["part"], c["class"], first, many, c["volume"] / c["n"]))
    return runs, rest


_RUNS = "part int, class int, first long, many long, gap_part int, gap_class int, gap_first long, slots int"


def best_fit(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(id, sequence_id, offset) for (id long, length from 1 to ``capacity``); ids are unique.

    Offsets of a sequence are gapless from 0.  An empty table gives an empty table.
    """
    spark = sizes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    length = F.col("length").cast("int")
    none = F.lit(0).cast("int")
    placed = [sizes.filter(length == capacity).select("id", F.col("id").alias("sequence_id"), none.alias("offset"))]
    state = sizes.filter(length < capacity).select(F.lit(PIECE).alias("kind"), "id", length.alias("size"))
    for _ in range(MAX_ROUNDS):
        ranged = state.repartitionByRange(parts, F.desc("size"), "kind", "id")
        swept = store(ranged.mapInArrow(lean(_sweep_range), _SWEPT), "swept", batch_rows=10_000)
        open_rows = swept.filter((F.col("kind") == GAP) | F.col("seq").isNull())
        counts = (
            open_rows.groupBy("part", "kind", "class")
            .agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("low"), F.max("size").alias("high"), F.sum("size").alias("volume"))
            .collect()
        )
        local = swept.filter("kind = 1 and seq is not null")
        placed.append(local.select("id", F.col("seq").alias("sequence_id"), (F.lit(capacity) - F.col("before")).alias("offset")))
        unplaced = sum(c["volume"] for c in counts if c["kind"] == PIECE)
        if not unplaced:
            break
        runs, rest = _match(counts)
        left = sum(many * mean for _, _, _, many, mean in rest)
        if left and unplaced - left <= LITTLE * unplaced:
            want = math.ceil(left / capacity)
            for part, group, first, many, _ in rest:
                if want > 0:
                    runs.append((part, group, first, min(want, many), None, None, None, None))
                    want -= many
        # at most one row per pair of neighbouring segments of the counts, so this is small and may be broadcast
        table = F.broadcast(spark.createDataFrame(runs, _RUNS))
        pieces_left = swept.filter("kind = 1 and seq is null")
        at = F.col("rank") - F.col("first")
        matched = (
            pieces_left.select("part", "class", "id", "size", "rank")
            .join(table.withColumn("hit", F.lit(True)), ["part", "class"], "left")
            .withColumn("hit", F.coalesce(F.col("hit") & (at >= 0) & (at < F.col("many")), F.lit(False)))
        )
        inside = matched.filter("hit and slots is not null").select(
            "id", "size", "rank", "gap_part", "gap_class", (F.col("gap_first") + F.floor(at / F.col("slots"))).alias("gap_rank")
        )
        gaps = swept.filter((F.col("kind") == GAP) & (F.col("size") > 0))
        targets = gaps.select(
            F.col("part").alias("gap_part"),
            F.col("class").alias("gap_class"),
            F.col("rank").alias("gap_rank"),
            F.col("id").alias("sequence_id"),
            F.col("size").alias("gap"),
        )
        order = Window.partitionBy("sequence_id").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        filled = F.sum("size").over(order)
        begun = matched.filter("hit and slots is null").select(
            "id", F.col("id").alias("sequence_id"), none.alias("offset"), "size", F.lit(True).alias("new")
        )
        moved = store(
            inside.join(targets, ["gap_part", "gap_class", "gap_rank"])
            .select(
                "id",
                "sequence_id",
                (F.lit(capacity) - F.col("gap") + filled - F.col("size")).cast("int").alias("offset"),
                "size",
                F.lit(False).alias("new"),
            )
            .unionByName(begun),
            "moved",
        )
        placed.append(moved.select("id", "sequence_id", "offset"))
        used = moved.filter("not new").groupBy(F.col("sequence_id").alias("id")).agg(F.sum("size").alias("_used"))
        kept_gaps = gaps.select("id", "size").join(used, "id", "left").select(
            F.lit(GAP).alias("kind"), "id", (F.col("size") - F.coalesce("_used", F.lit(0))).cast("int").alias("size")
        )
        new_gaps = moved.filter("new").select(F.lit(GAP).alias("kind"), "id", (F.lit(capacity) - F.col("size")).cast("int").alias("size"))
        waiting = (
            matched.groupBy("id", "size").agg(F.max("hit").alias("hit")).filter("not hit").select(F.lit(PIECE).alias("kind"), "id", "size")
        )
        state = kept_gaps.unionByName(new_gaps).unionByName(waiting).filter("size > 0")
    else:
        raise RuntimeError(f"pieces are left after {MAX_ROUNDS} rounds")
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (rows of ``pieces`` with or without the ids, or any table with ``length``), each row with its
    sequence_id and offset; every row is placed once and in whole."""
    kept = store(cut.withColumn("id", F.monotonically_increasing_id()), "pieces")
    found = best_fit(kept.select("id", "length"), capacity)
    return kept.join(found, "id").drop("id").withColumn("offset", F.col("offset").cast("long"))


def in_file_order(docs: DataFrame, name: str = "_position") -> DataFrame:
    """``docs`` with the column ``name``, which grows in the order in which its Parquet files were written.

    It is the number of the partition that wrote the row (0 for files of other names) times 2^32, and the row's place in
    its file.  Rows that come from no Parquet file keep the order of their partitions.
    """
    number = F.coalesce(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long"), F.lit(0))
    try:
        return docs.withColumn(name, number * F.lit(FILE_ROWS) + F.col("_metadata.row_index"))
    except AnalysisException:
        row = F.monotonically_increasing_id()  # the partition's number times 2^33, and the row's place
        return docs.withColumn(name, F.shiftright(row, 33) * F.lit(FILE_ROWS) + row % (1 << 33))


def _narrowed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a piece in two bytes each if all of them fit; ``length`` tells which it is."""
    for batch in batches:
        wide = [np.frombuffer(v, "<u4") for v in batch.column("ids").to_pylist()]
        ids = [(v.astype("<u2") if not len(v) or v.max() < 1 << 16 else v).tobytes() for v in wide]
        yield batch.set_column(batch.schema.get_field_index("ids"), "ids", pa.array(ids, pa.binary()))


def _widened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist())
        ids = [v if len(v) == 4 * n else np.frombuffer(v, "<u2").astype("<u4").tobytes() for v, n in pairs]
        yield batch.set_column(batch.schema.get_field_index("ids"), "ids", pa.array(ids, pa.binary()))


def pack_in_order(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pack`` for pieces with ``position``, sequences in the order of their content.

    Ids that fit travel in two bytes through the shuffles, and come out as ``pieces`` gave them.

    ``sequence_time`` is the mean position of a sequence's ids; rows come in ranges of it,
    sorted by it, the sequence and the offset, so a reader that goes through the files trains in the order of positions.
    """
    narrow = cut.mapInArrow(lean(_narrowed), cut.schema)
    kept = store(narrow.withColumn("id", F.monotonically_increasing_id()), "pieces")
    found = best_fit(kept.select("id", "length"), capacity)
    placed = store(found.join(kept.select("id", "position", "length"), "id"), "placed")
    # whole numbers, so that reruns agree: positions stay below 2^51 (2^19 files), a sequence below 2^12 ids
    moment = F.sum(F.col("position") * F.col("length")) / F.sum("length")
    times = placed.groupBy("sequence_id").agg(moment.alias("sequence_time"))
    timed = placed.select("id", "sequence_id", F.col("offset").cast("long").alias("offset")).join(times, "sequence_id")
    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["sequence_time", "sequence_id", "offset"]
    sorted_rows = kept.join(timed, "id").drop("id").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(lean(_widened), sorted_rows.schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Packed pieces of ``docs`` with their token ids."""
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity)
