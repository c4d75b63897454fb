"""Many searches at once over an index, each with its own size, offset and fields.

Postings of the wanted terms carry their BM25 weight, which no query changes, and are dealt into document partitions by a
hash of the id, so no (query, document) pair is ever shuffled.  A partition meets all queries in one task and keeps the
best documents of each; what leaves it is at most size + offset rows per query.

Inside a partition documents are numbered by the weight they have in all, heaviest first, and postings lie in blocks of
``BLOCK`` documents with the largest weight per term and block.  The sum of a query's block weights bounds the score of
every document of the block.  Blocks are scored from the largest bound down, and the query is done when the next bound
is below the last score it keeps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ranking import top_per_key
from corpusloom.operators.search import Index, _exact, query_terms, term_weight
from corpusloom.session import work_path

BLOCK_BITS = 5  # 32 documents
PART_POSTINGS = 1_000_000  # postings of wanted terms per document partition, about 40 MB in a task
SLACK = 1e-9  # far above what the order of a sum's terms can change


class Partition:
    """The postings of some documents: numbers of documents and terms, in blocks."""

    def __init__(self, ids: pa.ChunkedArray, keys: np.ndarray, weights: np.ndarray):
        coded = pc.dictionary_encode(ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids)
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        self.ids = coded.dictionary
        doc = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(self.ids)
        heavy = np.argsort(-np.bincount(doc, weights, n), kind="stable")
        number = np.empty(n, np.int64)
        number[heavy] = np.arange(n)
        self.place = heavy  # the id of a document's number
        self.id_rank = np.empty(n, np.int64)
        self.id_rank[pc.sort_indices(self.ids).to_numpy()] = np.arange(n)
        doc = number[doc]
        self.terms, term = np.unique(keys, return_inverse=True)
        order = np.lexsort((doc, term))
        self.doc, self.weight, term = doc[order], weights[order], term[order]
        self.blocks = (n >> BLOCK_BITS) + 1
        block = self.doc >> BLOCK_BITS
        begins = np.flatnonzero(np.diff(term * self.blocks + block, prepend=-1))
        self.begin, self.count = begins, np.diff(begins, append=len(term))
        self.block = block[begins]
        self.most = np.maximum.reduceat(self.weight, begins) if len(begins) else np.zeros(0)
        self.first = np.searchsorted(term[begins], np.arange(len(self.terms) + 1))

    def best(self, keys: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``ids`` and scores of the ``need`` best documents, equal scores by id."""
        at = np.searchsorted(self.terms, keys)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == keys)] if len(self.terms) else at[:0]
        if not len(at) or need <= 0:
            return np.zeros(0, np.int64), np.zeros(0)
        entries = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t in at])
        bound = np.bincount(self.block[entries], self.most[entries], self.blocks)
        ordered = np.argsort(-bound, kind="stable")
        ordered = ordered[bound[ordered] > 0]
        docs, scores, last = np.zeros(0, np.int64), np.zeros(0), -1.0
        at, step = 0, max(8, 2 * (need >> BLOCK_BITS))
        while at < len(ordered) and bound[ordered[at]] >= last - SLACK:
            wanted = np.zeros(self.blocks, bool)
            wanted[ordered[at : at + step]] = True
            some = entries[wanted[self.block[entries]]]
            sizes = self.count[some]
            ends = np.cumsum(sizes)
            rows = np.repeat(self.begin[some] - (ends - sizes), sizes) + np.arange(int(ends[-1]))
            found, where = np.unique(self.doc[rows], return_inverse=True)
            docs = np.concatenate([docs, found])
            scores = np.concatenate([scores, np.bincount(where, self.weight[rows])])
            if len(scores) >= need:
                last = np.partition(scores, len(scores) - need)[len(scores) - need]
                kept = scores >= last - SLACK
                docs, scores = docs[kept], scores[kept]
            at, step = at + step, 2 * step
        places = self.place[docs]
        order = np.lexsort((self.id_rank[places], -np.round(scores, 12)))[:need]
        return places[order], scores[order]


def _search_partition(postings: pa.Table, asked: pa.Table) -> pa.Table:
    part = Partition(postings["_id"], postings["key"].to_numpy(), postings["weight"].to_numpy())
    qids = pc.dictionary_encode(asked["qid"].combine_chunks())
    if isinstance(qids, pa.ChunkedArray):
        qids = qids.combine_chunks()
    number = qids.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(number, kind="stable")
    keys, need, skip = (asked[c].to_numpy()[order] for c in ("key", "need", "skip"))
    edges = np.searchsorted(number[order], np.arange(len(qids.dictionary) + 1))
    out_q, out_d, out_s, out_n, out_k = [], [], [], [], []
    for q, (low, high) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        places, scores = part.best(np.sort(keys[low:high]), int(need[low]))
        out_q.append(np.full(len(places), q))
        out_d.append(places)
        out_s.append(scores)
        out_n.append(np.full(len(places), need[low], np.int32))
        out_k.append(np.full(len(places), skip[low], np.int32))
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return pa.table(
        {
            "qid": qids.dictionary.take(pa.array(join(out_q, np.int64))),
            "_id": part.ids.take(pa.array(join(out_d, np.int64))),
            "score": pa.array(join(out_s, np.float64)),
            "need": pa.array(join(out_n, np.int32)),
            "skip": pa.array(join(out_k, np.int32)),
        }
    )


def msearch(index: Index, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ranked documents of every query: ``(qid, rank, _id, score)``.

    ``queries`` has (qid, query) and may have ``size`` and ``offset`` (whole numbers, ``k`` and 0 where absent or null)
    and ``fields`` (the fields a query looks into, all where absent or null).  Ranks count from 1 before the offset is
    cut off.  qids must be unique and not null.
    """
    given = lambda c, default: F.coalesce(F.col(c), default) if c in queries.columns else default
    bodies = queries.select(
        "qid",
        (given("size", F.lit(k)) + given("offset", F.lit(0))).cast("int").alias("need"),
        given("offset", F.lit(0)).cast("int").alias("skip"),
        (F.col("fields") if "fields" in queries.columns else F.lit(None).cast("array<string>")).alias("_fields"),
    )
    asked = query_terms(queries).join(bodies, "qid").join(index.freq, "term")
    asked = asked.filter(F.col("_fields").isNull() | F.array_contains("_fields", F.col("field")))
    # Stored, the few rows are made once and their size is known, so the optimizer broadcasts them if they are small.
    path = work_path(queries.sparkSession, "asked")
    asked.select("qid", "need", "skip", "field", "term", "df").write.parquet(path)
    asked = queries.sparkSession.read.parquet(path)
    key = F.xxhash64("field", "term").alias("key")
    wanted = asked.select("field", "term", "df").distinct()
    facts = wanted.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("postings")).first()
    most = bodies.agg(F.coalesce(F.max("need"), F.lit(0)).alias("n")).first()["n"]
    spark = queries.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-facts["postings"] // PART_POSTINGS))
    weight = term_weight(F.col("tf"), F.col("length"), F.col("df"), F.col("n_docs"), F.col("avg_length"), k1, b)
    part = F.pmod(F.xxhash64("_id"), F.lit(parts)).alias("part")
    rows = index.wanted(wanted.withColumn("key", key)).select(part, "_id", "key", weight.alias("weight"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
    bids = asked.select("qid", key, "need", "skip", each)
    kinds = {c: t.simpleString() for c, t in [("qid", queries.schema["qid"].dataType), ("_id", index.postings.schema["_id"].dataType)]}
    schema = f"qid {kinds['qid']}, _id {kinds['_id']}, score double, need int, skip int"
    found = rows.groupBy("part").cogroup(bids.groupBy("part")).applyInArrow(_search_partition, schema)
    top = top_per_key(found, ["qid"], [_exact("score").desc(), F.col("_id")], max(most, 1), rank="rank")
    kept = top.filter((F.col("rank") <= F.col("need")) & (F.col("rank") > F.col("skip")))
    return kept.select("qid", "rank", "_id", F.round("score", 6).alias("score"))
