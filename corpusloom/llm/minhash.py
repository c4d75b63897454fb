"""Near copies: many universal hash minima, banding, signature verification, exact confirmation, star components.

1. Every text's set of word shingles gives a digest of the set and ``bands * rows`` minima of universal hashes.
   Texts with equal sets fall together; one of them stands for all.
2. Bands of minima give buckets.  Inside a bucket signatures are compared; a bucket larger than a block is cut into
   blocks, and each pair of blocks is one task's work, so no group is gathered whole and no pairs are written: a task
   writes only which of its members hang together at ``threshold - margin``.
3. The groups that hang together are compared on full shingle sets, again in blocks, and again a task writes only
   which members hang together by confirmed links.
4. Alternating large-star and small-star rounds make components of the confirmed links.

With 25 bands of 5 minima a pair at similarity 0.85 shares no bucket with probability 4e-7, one at 0.80 with 5e-5; the
margin is five standard errors of the estimate from 125 minima.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.llm.wordhash import WIDTH, constants, mix, shingle_sets
from corpusloom.llm.work import binary_views, lean, runs, store

BANDS, ROWS = 25, 5
BLOCK_DOCS = 256
ERRORS = 5  # standard errors that an estimate may be below the threshold
_STEP = 1024


def minima(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The least value of each universal hash ``(a x + b) mod 2**64 >> 32`` over a non-empty set."""
    least = np.full(len(factors), 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), _STEP):
            part = factors[:, None] * shingles[None, at : at + _STEP] + shifts[:, None]
            np.minimum(least, (part >> np.uint64(32)).min(axis=1), out=least)
    return least.astype(np.uint32)


def signatures(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig): set size, 128-bit digest of the set, minima as little-endian 32-bit values.

    An empty set has an empty signature.
    """
    count = bands * rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = constants(count, 3), constants(count, 4)
        for batch in batches:
            sizes, first, second, sigs = [], [], [], []
            for found in shingle_sets(batch.column("text"), width):
                sizes.append(len(found))
                with np.errstate(over="ignore"):
                    first.append(int(found.sum(dtype=np.uint64)))
                    second.append(int(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                sigs.append(minima(found, factors, shifts).tobytes() if len(found) else b"")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(first, np.uint64).view(np.int64)),
                    pa.array(np.array(second, np.uint64).view(np.int64)),
                    pa.array(sigs, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "sig"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(lean(run), "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def band_keys(sigs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(band, doc_id): one row per document and band; the key is a hash of the band's number and its minima."""
    part = [F.substring("sig", 1 + 4 * rows * b, 4 * rows) for b in range(bands)]
    keys = F.array(*[F.xxhash64(F.lit(b), p) for b, p in enumerate(part)])
    return sigs.select(F.explode(keys).alias("band"), "doc_id")


def blocks_of(members: DataFrame, key: str, id_column: str, block: int) -> DataFrame:
    """Members of groups with two or more members, as rows of block pairs (key, one, other).

    A group of n members has ceil(n / block) blocks.  Each pair of blocks, a block with itself included, is a group
    of bounded size; a member is a row of every pair that has its block.
    """
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    count = F.ceil(F.col("_n") / block).cast("int")
    own = F.pmod(F.xxhash64(id_column, F.lit("block")), F.col("_blocks")).cast("int")
    return (
        members.join(sizes, key)
        .withColumn("_blocks", count)
        .withColumn("own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            *members.columns,
            "own",
            F.least("own", "_other").alias("one"),
            F.greatest("own", "_other").alias("other"),
        )
    )


class Forest:
    """Union-find over the rows of one block pair."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)

    def stars(self, ids: np.ndarray) -> tuple[list[int], list[int]]:
        """(member, smallest-placed member of its tree) for all that are not alone."""
        roots = [self.find(x) for x in range(len(ids))]
        return [int(ids[x]) for x, r in enumerate(roots) if x != r], [int(ids[r]) for x, r in enumerate(roots) if x != r]


def _alike(sigs: np.ndarray, own: np.ndarray, one: int, other: int, least: float) -> list[tuple[int, int]]:
    """Pairs (x < y) of the block pair with at least that share of equal minima, the likest first."""
    left = np.flatnonzero(own == one)
    right = left if one == other else np.flatnonzero(own == other)
    found = []
    for at in range(0, len(left), 32):
        part = left[at : at + 32]
        equal = (sigs[part][:, None, :] == sigs[right][None, :, :]).sum(axis=2)
        for x, y in np.argwhere(equal >= least * sigs.shape[1]).tolist():
            if one != other or right[y] > part[x]:
                found.append((-int(equal[x, y]), int(part[x]), int(right[y])))
    found.sort()
    return [(x, y) for _, x, y in found]


def _edges(us: list[int], vs: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _signature_links(least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us: list[int] = []
        vs: list[int] = []
        for group in runs(batches, ["band", "one", "other"]):
            ids, own = group["doc_id"].to_numpy(), group["own"].to_numpy()
            sigs = np.stack(binary_views(group["sig"], np.uint32))
            forest = Forest(len(ids))
            for x, y in _alike(sigs, own, group["one"][0].as_py(), group["other"][0].as_py(), least):
                forest.join(x, y)
            u, v = forest.stars(ids)
            us += u
            vs += v
            if len(us) > 10_000:
                yield _edges(us, vs)
                us, vs = [], []
        yield _edges(us, vs)

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct values."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    places = np.searchsorted(b, a)
    places[places == len(b)] = 0
    common = int((b[places] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirmed_links(percent: int, least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us: list[int] = []
        vs: list[int] = []
        for group in runs(batches, ["cluster", "one", "other"]):
            ids, own = group["doc_id"].to_numpy(), group["own"].to_numpy()
            sigs = np.stack(binary_views(group["sig"], np.uint32))
            sets = binary_views(group["shingles"], np.uint64)
            forest = Forest(len(ids))
            for x, y in _alike(sigs, own, group["one"][0].as_py(), group["other"][0].as_py(), least):
                if forest.find(x) != forest.find(y) and linked(sets[x], sets[y], percent):
                    forest.join(x, y)
            u, v = forest.stars(ids)
            us += u
            vs += v
            if len(us) > 10_000:
                yield _edges(us, vs)
                us, vs = [], []
        yield _edges(us, vs)

    return run


def _shingle_rows(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [found.tobytes() for found in shingle_sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = WIDTH, block: int = BLOCK_DOCS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets; ``component_id`` is the
    smallest doc_id reachable over links.  ``kept`` holds for the document that stands for its component.

    A null or blank text has an empty set and is linked with nothing.  A row with a null doc_id is its own component
    (null) and kept.  Rows that repeat a doc_id and a text are one document and get equal results; if a doc_id has
    different texts, each row follows its own text.  Other columns are ignored.  No rows give no rows.
    """
    share = percent / 100
    least = share - ERRORS * (share * (1 - share) / (BANDS * ROWS)) ** 0.5
    sigs = store(signatures(docs, width), "signatures")
    filled = sigs.filter("n_shingles > 0 and doc_id is not null")
    groups = filled.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = store(filled.join(groups.select(F.col("rep").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"], "left_semi")
                 .select("doc_id", "sig").dropDuplicates(["doc_id"]), "representatives")

    buckets = blocks_of(band_keys(reps), "band", "doc_id", block)
    compared = (
        buckets.join(reps, "doc_id")
        .repartition("band", "one", "other")
        .sortWithinPartitions("band", "one", "other", "doc_id")
        .select("band", "one", "other", "own", "doc_id", "sig")
    )
    near = components(compared.mapInArrow(lean(_signature_links(least)), "u long, v long"))

    clusters = store(near.withColumnsRenamed({"node": "doc_id", "component": "cluster"}), "clusters")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = texts.join(clusters.select("doc_id"), "doc_id", "left_semi").mapInArrow(
        lean(_shingle_rows(width)), "doc_id long, shingles binary"
    )
    # a doc_id with several texts: any of them may stand here, links are confirmed on what stands
    members = blocks_of(clusters, "cluster", "doc_id", block)
    confirmed = (
        members.join(reps, "doc_id")
        .join(sets, "doc_id")
        .repartition("cluster", "one", "other")
        .sortWithinPartitions("cluster", "one", "other", "doc_id")
        .select("cluster", "one", "other", "own", "doc_id", "sig", "shingles")
    )
    found = components(confirmed.mapInArrow(lean(_confirmed_links(percent, least)), "u long, v long"))
    labels = groups.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("_component")
    )
    component: Column = F.coalesce("_component", "doc_id")
    return (
        sigs.drop("sig")
        .join(labels, ["d1", "d2", "n_shingles"], "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
