"""Text index, ranked search, and the other query forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators.joins import salted_join
from corpusloom.session import checkpoint_root, small_batches, work_path

AUTOMATON_CHARS = 8_000_000  # about 400 MB in a worker


@dataclass(frozen=True)
class Index:
    """``postings(_id, field, term, tf, length)``, ``stats(field, n_docs, avg_length)``, ``freq(field, term, df)``.

    A posting carries its field length, so scoring needs no join with the documents.  An index that keeps its postings in
    ``blocks(field, term, ids, tfs, lengths)`` meets wanted terms block by block, before the postings become rows.
    """

    postings: DataFrame
    stats: DataFrame
    freq: DataFrame
    blocks: DataFrame | None = None

    def wanted(self, terms: DataFrame) -> DataFrame:
        """Postings of a table of terms ``(field, term, ...)`` with its other columns and the fields' statistics."""
        rows = self.postings if self.blocks is None else self.blocks
        rows = rows.join(terms, ["field", "term"]).join(F.broadcast(self.stats), "field")
        return rows if self.blocks is None else _unfolded(rows)


def analyze(
    docs: DataFrame, id_col: str, fields: Sequence[str], stop_words=tx.STOP_WORDS, dictionary: Sequence[str] = ()
) -> DataFrame:
    """Term vectors: ``(id, field, term, pos, start, end)``."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("_id"), *fields).mapInArrow(
        tx.located_terms(fields, stop_words, dictionary), f"_id {kind}, field string, term string, pos int, start int, end int"
    )
    return found.withColumnRenamed("_id", id_col)


def term_places(docs: DataFrame, id_col: str, fields: Sequence[str], stop_words=tx.STOP_WORDS) -> DataFrame:
    """``(_id, field, term, tf, places<pos, start, end>)`` with the places in order; rows of one id count as one text."""
    kind = docs.schema[id_col].dataType.simpleString()
    places = "array<struct<pos:int,start:int,end:int>>"
    found = docs.select(F.col(id_col).alias("_id"), *fields).mapInArrow(
        tx.grouped_terms(fields, stop_words), f"_id {kind}, field string, term string, places {places}"
    )
    merged = F.array_sort(F.flatten(F.collect_list("places")))
    return found.groupBy("_id", "field", "term").agg(F.sum(F.size("places")).alias("tf"), merged.alias("places"))


def field_terms(docs: DataFrame, id_col: str, fields: Sequence[str], stop_words=tx.STOP_WORDS, dictionary=()) -> DataFrame:
    """``(_id, field, terms)``: one row per document and field, from one pass over the table."""
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("field"), tx.terms(F.coalesce(F.col(f), F.lit("")), stop_words, dictionary).alias("terms"))
            for f in fields
        ]
    )
    return docs.select(F.col(id_col).alias("_id"), F.explode(pairs).alias("_f")).select("_id", "_f.field", "_f.terms")


def dictionary_terms(
    docs: DataFrame, id_col: str, field: str, dictionary: DataFrame, stop_words: DataFrame | None = None
) -> DataFrame:
    """``(id, terms)`` by a dictionary table ``(word)`` of any size; stop words may be a table ``(word)`` too.

    At every place of a text the longest dictionary word counts, else a run of
    word characters, else a single CJK character.  Rows keep their null and
    repeated ids.  Words and stop words together are stored, and up to
    ``AUTOMATON_CHARS`` characters every worker loads them into one automaton;
    texts are not shuffled.  A larger dictionary meets the pieces of the texts
    in an equality join.
    """
    lower = lambda df, stop: df.select(F.lower("word").alias("word"), F.lit(stop).alias("stop")).filter("word <> ''").distinct()
    stored = lower(dictionary, False)
    if stop_words is not None:
        stored = stored.unionByName(lower(stop_words, True))
    path = work_path(docs.sparkSession, "dictionary")
    stored.write.parquet(path)
    stored = docs.sparkSession.read.parquet(path)
    if (stored.agg(F.sum(F.char_length("word"))).first()[0] or 0) <= AUTOMATON_CHARS:
        return docs.select(id_col, tx.terms_by_dictionary(F.lower(F.coalesce(F.col(field), F.lit(""))), path).alias("terms"))
    checkpoint_root(docs.sparkSession)
    numbered = docs.select(F.col(id_col).alias("_given"), F.col(field), F.monotonically_increasing_id().alias("_row")).checkpoint()
    found = _joined_terms(numbered, "_row", field, stored.filter("not stop"), stored.filter("stop"))
    return numbered.select("_given", "_row").join(found, "_row").select(F.col("_given").alias(id_col), "terms")


def _joined_terms(docs: DataFrame, id_col: str, field: str, dictionary: DataFrame, stop_words: DataFrame) -> DataFrame:
    """(id, terms) by an equality join of text pieces as long as dictionary words with the words; ids are unique."""
    words = dictionary.select(F.lower("word").alias("word")).filter("word <> ''").distinct()
    # one row per length of a word
    lengths = sorted(r[0] for r in words.select(F.char_length("word")).distinct().collect())
    text = docs.select(F.col(id_col), F.lower(F.coalesce(F.col(field), F.lit(""))).alias("_text"))
    places = F.sequence(F.lit(1), F.char_length("_text"))
    sizes = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    pieces = (
        text.filter("_text <> ''")
        .select(id_col, "_text", F.explode(places).alias("_at"))
        .select(id_col, "_at", F.substr("_text", F.col("_at"), F.lit(max(lengths, default=1))).alias("_piece"))
        .select(id_col, "_at", "_piece", F.explode(sizes).alias("_n"))
        .filter(F.col("_n") <= F.char_length("_piece"))
        .select(id_col, "_at", "_n", F.substr("_piece", F.lit(1), F.col("_n")).alias("word"))
    )
    longest = pieces.join(words, "word").groupBy(id_col, "_at").agg(F.max("_n").alias("n"))
    starts = longest.groupBy(id_col).agg(F.collect_list(F.struct((F.col("_at") - 1).alias("at"), "n")).alias("_starts"))
    terms = text.join(starts, id_col, "left").select(id_col, tx.terms_at(F.col("_text"), F.col("_starts")).alias("terms"))
    rows = terms.select(id_col, F.posexplode("terms").alias("_i", "word"))
    kept = rows.join(stop_words.select(F.lower("word").alias("word")).distinct(), "word", "left_anti")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_i", "word"))), lambda x: x["word"])
    some = kept.groupBy(id_col).agg(ordered.alias("terms"))
    none = F.array().cast("array<string>")
    return terms.select(id_col).join(some, id_col, "left").select(id_col, F.coalesce("terms", none).alias("terms"))


def build_index(
    docs: DataFrame, fields: Sequence[str], id_col: str = "_id", stop_words=tx.STOP_WORDS, dictionary=()
) -> Index:
    """Postings and statistics as lazy tables; ``write_index`` stores them for many searches.

    Terms of a document are counted inside its task, so postings need no shuffle.
    """
    return _index(_term_blocks(docs, fields, id_col, stop_words, dictionary))


def _term_blocks(docs: DataFrame, fields: Sequence[str], id_col: str, stop_words=tx.STOP_WORDS, dictionary=()) -> DataFrame:
    """``(field, term, ids, tfs, lengths, n, total)`` of all texts, each analyzed once; see ``text.term_blocks``."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = [F.lower(F.coalesce(F.col(f), F.lit(""))).alias(f"_text{i}") for i, f in enumerate(fields)]
    schema = f"field string, term string, ids array<{kind}>, tfs array<int>, lengths array<int>, n bigint, total bigint"
    return docs.select(F.col(id_col).alias("_id"), *texts).mapInArrow(tx.term_blocks(fields, stop_words, dictionary), schema)


def _unfolded(blocks: DataFrame) -> DataFrame:
    rows = blocks.withColumn("_docs", F.explode(F.arrays_zip("ids", "tfs", "lengths"))).drop("ids", "tfs", "lengths")
    return rows.select("*", F.col("_docs.ids").alias("_id"), F.col("_docs.tfs").alias("tf"), F.col("_docs.lengths").alias("length")).drop("_docs")


def _index(counted: DataFrame, blocks: DataFrame | None = None) -> Index:
    blocks = counted.filter("term is not null").select("field", "term", "ids", "tfs", "lengths") if blocks is None else blocks
    stats = counted.filter("term is null").groupBy("field").agg(F.sum("n").alias("n_docs"), (F.sum("total") / F.sum("n")).alias("avg_length"))
    freq = counted.filter("term is not null").groupBy("field", "term").agg(F.sum("n").alias("df"))
    return Index(_unfolded(blocks).select("_id", "field", "term", "tf", "length"), stats, freq, blocks)


def write_index(
    docs: DataFrame, fields: Sequence[str], path: str, id_col: str = "_id", partitions: int | None = None, **analyzer
) -> None:
    """Store an index clustered by term: a query then reads few row groups.

    Without ``partitions`` the size decides: range partitions are merged or split
    by adaptive execution to its advisory size.

    The texts are analyzed once, into blocks of postings with a term; a block is one row of every shuffle.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        _term_blocks(docs, fields, id_col, **analyzer).write.mode("overwrite").parquet(f"{path}/counted")
    index = _index(spark.read.parquet(f"{path}/counted"))
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")
    by = ["term", F.get("ids", F.lit(0))]
    by_term = index.blocks.repartitionByRange(partitions, *by) if partitions else index.blocks.repartitionByRange(*by)
    by_term.sortWithinPartitions("term", "field").write.mode("overwrite").parquet(f"{path}/blocks")
    index.freq.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/freq")


def _field_stats(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"))


def read_index(spark, path: str) -> Index:
    blocks, stats, freq = (spark.read.parquet(f"{path}/{part}") for part in ("blocks", "stats", "freq"))
    return Index(_unfolded(blocks).select("_id", "field", "term", "tf", "length"), stats, freq, blocks)


def term_documents(docs: DataFrame, id_col: str, fields: Sequence[str], stop_words=tx.STOP_WORDS, dictionary=()) -> DataFrame:
    """Documents per term and field straight from the texts, each term once per document."""
    rows = field_terms(docs, id_col, fields, stop_words, dictionary)
    return doc_freq(rows.select("field", F.explode(F.array_distinct("terms")).alias("term")))


def field_stats(docs: DataFrame, id_col: str, fields: Sequence[str], stop_words=tx.STOP_WORDS, dictionary=()) -> DataFrame:
    """Number of documents and mean length in terms of each field."""
    rows = field_terms(docs, id_col, fields, stop_words, dictionary)
    return _field_stats(rows.select("field", F.size("terms").alias("length")))


def doc_freq(postings: DataFrame) -> DataFrame:
    """Documents per term and field; a posting is unique per (document, field, term)."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def term_weight(tf: Column, length: Column, df: Column, n_docs: Column, avg_length: Column, k1: float, b: float) -> Column:
    """BM25 of one term in one field."""
    idf = F.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * length / avg_length))


def _exact(score: str) -> Column:
    """The score as it is ordered: to twelve places, so that the order of a sum's terms does not decide."""
    return F.round(score, 12)


def _scored(index: Index, asked: Column, k1: float, b: float, boosts: Mapping[str, float] | None) -> DataFrame:
    """Postings of the terms that ``asked`` lets through, a few literals, with their weight."""
    asked_only = Index(index.postings.filter(asked), index.stats, index.freq, None if index.blocks is None else index.blocks.filter(asked))
    joined = asked_only.wanted(F.broadcast(index.freq.filter(asked)))
    weight = term_weight(F.col("tf"), F.col("length"), F.col("df"), F.col("n_docs"), F.col("avg_length"), k1, b)
    for field, factor in (boosts or {}).items():
        weight = F.when(F.col("field") == field, weight * factor).otherwise(weight)
    return joined.select("_id", "field", "term", weight.alias("weight"))


def search(
    index: Index,
    query: str,
    size: int = 10,
    offset: int = 0,
    k1: float = 1.2,
    b: float = 0.75,
    boosts: Mapping[str, float] | None = None,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """Documents ranked by the BM25 of the query's terms, summed over fields.

    The terms are literals, so the filter reaches the postings' Parquet statistics.
    """
    asked = F.col("term").isin(sorted(set(tx.terms_of(query))))
    if fields is not None:
        asked = asked & F.col("field").isin(list(fields))
    weights = _scored(index, asked, k1, b, boosts)
    scores = weights.groupBy("_id").agg(F.sum("weight").alias("score"))
    top = scores.orderBy(_exact("score").desc(), "_id").offset(offset).limit(size)
    return top.withColumn("score", F.round("score", 6))


def scan_search(
    docs: DataFrame, id_col: str, field: str, query: str, size: int = 10, offset: int = 0, k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """The same ranking straight from the texts, for a table without an index.

    Each document is reduced to its length and the counts of the query's terms
    inside its row; only one row of statistics and the top rows move.
    """
    wanted = sorted(set(tx.terms_of(query)))
    if not wanted:
        return docs.select(F.col(id_col).alias("_id"), F.lit(0.0).alias("score")).limit(0)
    found = tx.terms(F.coalesce(F.col(field), F.lit("")))

    def occurrences(word: str) -> Column:
        return F.size(F.filter("_terms", lambda t: t == word))

    rows = docs.select(F.col(id_col).alias("_id"), found.alias("_terms")).select(
        "_id", F.size("_terms").alias("_len"), *[occurrences(w).alias(f"_tf{i}") for i, w in enumerate(wanted)]
    )
    # The narrow rows pass one exchange that both uses below share, so texts are read and analyzed once.
    rows = rows.repartition("_id")
    facts = rows.agg(
        F.struct(
            F.count("_id").alias("n"),
            F.avg("_len").alias("avg"),
            *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))],
        ).alias("s")
    ).scalar()
    weights = [
        term_weight(F.col(f"_tf{i}"), F.col("_len"), facts[f"df{i}"], facts["n"], facts["avg"], k1, b)
        for i in range(len(wanted))
    ]
    found_any = sum([F.col(f"_tf{i}") for i in range(1, len(wanted))], F.col("_tf0")) > 0
    scored = rows.select("_id", sum(weights[1:], weights[0]).alias("score"), found_any.alias("_hit"))
    # Documents without a term sort last and go after the limit; a filter before it would split the exchange.
    top = scored.orderBy(F.col("_hit").desc(), _exact("score").desc(), "_id").offset(offset).limit(size)
    return top.filter("_hit").drop("_hit").withColumn("score", F.round("score", 6))


def query_terms(queries: DataFrame, qid: str = "qid", query: str = "query") -> DataFrame:
    """``(qid, term)`` of a table of query texts, through the index analyzer."""
    return queries.select(qid, F.explode(F.array_distinct(tx.terms(F.col(query)))).alias("term"))


def match(docs: DataFrame, field: str, query: str, operator: str = "or") -> DataFrame:
    """Documents with any (or all) of the query's terms in the field."""
    return docs.filter(matches(F.col(field), query, operator))


def match_index(docs: DataFrame, index: Index, query: str, field: str, operator: str = "or", id_col: str = "_id") -> DataFrame:
    """``match`` by the postings: no text is read or analyzed, and the term filter reaches their Parquet statistics."""
    wanted = sorted(set(tx.terms_of(query)))
    found = index.postings.filter((F.col("field") == field) & F.col("term").isin(wanted)).select(F.col("_id").alias(id_col), "term")
    if operator != "or":
        found = found.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(wanted))
    return docs.join(found.select(id_col), id_col, "left_semi")


def bool_scored(
    index: Index,
    must: Sequence[tuple[str, str]] = (),
    should: Sequence[tuple[str, str]] = (),
    must_not: Sequence[tuple[str, str]] = (),
    filter: Sequence[tuple[str, str]] = (),
    minimum_should_match: int | None = None,
    size: int = 10,
    offset: int = 0,
    k1: float = 1.2,
    b: float = 0.75,
) -> DataFrame:
    """A composite query over the index: clauses are (field, text), a clause matches if one of its terms is there.

    The score is the BM25 sum of the matching ``must`` and ``should`` clauses; ``filter`` and ``must_not`` score
    nothing.  All clauses are aggregates of one pass over the postings of their terms.  Without ``must`` and ``filter``
    one ``should`` clause has to match; a query of ``must_not`` clauses alone finds nothing.
    """
    clauses = [(kind, f, sorted(set(tx.terms_of(t)))) for kind, part in (("must", must), ("should", should), ("must_not", must_not), ("filter", filter)) for f, t in part]
    within = [(F.col("field") == f) & F.col("term").isin(words) for _, f, words in clauses]
    asked = F.lit(False)
    for test in within:
        asked = asked | test
    weights = _scored(index, asked, k1, b, None)
    per_clause = [F.sum(F.when(test, F.col("weight")).otherwise(0.0)).alias(f"_s{i}") for i, test in enumerate(within)]
    hits = [F.max(test).alias(f"_h{i}") for i, test in enumerate(within)]
    rows = weights.groupBy("_id").agg(*per_clause, *hits)
    kept, matched, score = F.lit(True), F.lit(0), F.lit(0.0)
    for i, (kind, _, _) in enumerate(clauses):
        hit = F.col(f"_h{i}")
        if kind in ("must", "filter"):
            kept = kept & hit
        elif kind == "must_not":
            kept = kept & ~hit
        else:
            matched = matched + hit.cast("int")
        if kind in ("must", "should"):
            score = score + F.col(f"_s{i}")
    need = minimum_should_match if minimum_should_match is not None else int(bool(should) and not must and not filter)
    if not must and not filter and not need:
        need = 1
    found = rows.filter(kept & (matched >= need)).select("_id", score.alias("score"))
    top = found.orderBy(_exact("score").desc(), "_id").offset(offset).limit(size)
    return top.withColumn("score", F.round("score", 6))


def matches(text: Column, query: str, operator: str = "or") -> Column:
    """``match`` as a predicate for ``bool_query``; the terms are tested inside the row."""
    wanted = sorted(set(tx.terms_of(query)))
    if not wanted:
        return F.lit(False)
    found = tx.terms(F.coalesce(text, F.lit("")))
    asked = F.array(*[F.lit(w) for w in wanted])
    return F.arrays_overlap(found, asked) if operator == "or" else F.size(F.array_except(asked, found)) == 0


def term(value: Column, exact) -> Column:
    return value == exact


def between(value: Column, low=None, high=None) -> Column:
    """Range with both ends included; an absent end is open."""
    test = F.lit(True)
    if low is not None:
        test = test & (value >= low)
    if high is not None:
        test = test & (value <= high)
    return test


def missing(value: Column) -> Column:
    return value.isNull()


def bool_query(
    docs: DataFrame,
    must: Sequence[Column] = (),
    should: Sequence[Column] = (),
    must_not: Sequence[Column] = (),
    filter: Sequence[Column] = (),
    minimum_should_match: int | None = None,
    score: str | None = "score",
) -> DataFrame:
    """All of ``must`` and ``filter``, none of ``must_not``, enough of ``should``, over any predicates.

    The score counts matching ``must`` and ``should`` clauses; ``bool_scored`` adds up BM25.  Without ``must``
    and ``filter`` one ``should`` clause has to match.
    """
    hits = [F.coalesce(c, F.lit(False)).cast("int") for c in should]
    matched = sum(hits[1:], hits[0]) if hits else F.lit(0)
    need = minimum_should_match
    if need is None:
        need = 1 if should and not must and not filter else 0
    kept = docs
    for clause in [*must, *filter]:
        kept = kept.filter(clause)
    for clause in must_not:
        kept = kept.filter(~F.coalesce(clause, F.lit(False)))
    if need:
        kept = kept.filter(matched >= need)
    return kept if score is None else kept.withColumn(score, (F.lit(len(must)) + matched).cast("double"))


def count(docs: DataFrame, clause: Column | None = None) -> DataFrame:
    kept = docs if clause is None else docs.filter(clause)
    return kept.agg(F.count(F.lit(1)).alias("count"))


def percolate(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", field: str = "text") -> DataFrame:
    """Stored queries that match each document (all terms of the query): ``(doc_id, qid)``.

    A pair is formed only through the rarest term of the query, then its other
    terms are checked by an equality join on (document, term).  Neither join
    emits pairs of a frequent term that a rarer term rules out.
    """
    doc_terms = docs.select(
        F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(tx.terms(F.coalesce(F.col(field), F.lit(""))))).alias("term")
    )
    asked = query_terms(queries)
    vocabulary = asked.select("term").distinct()
    # The narrow rows are used three times; stored once, the texts are analyzed once.
    checkpoint_root(docs.sparkSession)
    doc_terms = doc_terms.join(vocabulary, "term", "left_semi").checkpoint()
    freq = doc_terms.groupBy("term").agg(F.count("doc_id").alias("df"))
    per_query = (
        asked.join(freq, "term", "left")
        .groupBy("qid")
        .agg(
            F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("term").alias("rare"))).alias("_r"),
            F.collect_list("term").alias("terms"),
        )
        .select("qid", F.col("_r.rare").alias("term"), "terms")
    )
    candidates = salted_join(doc_terms, per_query, ["term"], ["doc_id"])
    others = candidates.select("doc_id", "qid", F.explode(F.array_remove("terms", F.col("term"))).alias("term"))
    single = candidates.filter(F.size("terms") == 1).select("doc_id", "qid")
    need = per_query.filter(F.size("terms") > 1).select("qid", (F.size("terms") - 1).cast("long").alias("need"))
    confirmed = (
        others.join(doc_terms, ["doc_id", "term"], "left_semi")
        .groupBy("doc_id", "qid")
        .agg(F.count(F.lit(1)).alias("got"))
        .join(need, "qid")
        .filter(F.col("got") == F.col("need"))
        .select("doc_id", "qid")
    )
    return single.unionByName(confirmed)


def snippets(
    hits: DataFrame, docs: DataFrame, field: str, query: str, width: int = 80, id_col: str = "_id", marks=("<em>", "</em>")
) -> DataFrame:
    """Text around the first query term of each hit, with the terms marked: ``(_id, snippet, start)``."""
    wanted = sorted(set(tx.terms_of(query)), key=lambda w: (-len(w), w))
    letters = tx.WORD
    any_term = "|".join(wanted) or r"\z."
    whole = f"(?<![{letters}])(?:{any_term})(?![{letters}])"
    texts = docs.select(F.col(id_col), F.col(field).alias("_text"))
    found = hits.select(id_col).join(texts, id_col).withColumn("_at", F.regexp_instr(F.lower("_text"), F.lit(whole)))
    start = F.greatest(F.col("_at") - width // 2, F.lit(1))
    piece = F.substring(F.col("_text"), start, F.lit(width))
    marked = F.regexp_replace(piece, f"(?iu){whole}", f"{marks[0]}$0{marks[1]}")
    return found.filter(F.col("_at") > 0).select(id_col, marked.alias("snippet"), (start - 1).cast("long").alias("start"))


def has_child(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, minimum: int = 1) -> DataFrame:
    """Parents with at least ``minimum`` children; children are counted before the join."""
    keys = children.select(F.col(child_key).alias(parent_key))
    if minimum > 1:
        counted = keys.groupBy(parent_key).agg(F.count(F.lit(1)).alias("_n"))
        keys = counted.filter(F.col("_n") >= minimum).select(parent_key)
    return parents.join(keys, parent_key, "left_semi")


def has_parent(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def child_counts(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, by: str, parent_by: str) -> DataFrame:
    """Children per bucket of a child field within a bucket of a parent field.

    Children are counted per (parent, bucket) first, so a parent with very many
    children sends few rows into the join.
    """
    counted = children.groupBy(F.col(child_key).alias(parent_key), F.col(by)).agg(F.count(F.lit(1)).alias("_n"))
    joined = counted.join(parents.select(parent_key, parent_by), parent_key)
    return joined.groupBy(parent_by, by).agg(
        F.sum("_n").alias("children"), F.count(F.lit(1)).alias("parents")
    )


def matrix_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, variance, skewness, kurtosis of a field and covariance, correlation with another.

    One row per pair of fields in alphabetical order.  All pairs are aggregates
    over whole rows, folded in the map tasks; only their one row is taken apart.
    """
    pairs = [(a, b) for a in columns for b in columns if a <= b]
    whole = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    single = {"mean": F.avg, "variance": F.var_samp, "skewness": F.skewness, "kurtosis": F.kurtosis}
    moments = [f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in single.items()]
    both = [
        part
        for i, (a, b) in enumerate(pairs)
        for part in (F.covar_samp(a, b).alias(f"covariance_{i}"), F.corr(a, b).alias(f"correlation_{i}"))
    ]
    one = whole.agg(F.count(F.lit(1)).alias("count"), *moments, *both)
    place = {c: i for i, c in enumerate(columns)}
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("field"),
                F.lit(b).alias("other"),
                "count",
                *[F.col(f"{n}_{place[a]}").alias(n) for n in single],
                F.col(f"covariance_{i}").alias("covariance"),
                F.col(f"correlation_{i}").alias("correlation"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return one.filter("count > 0").select(F.inline(rows))


def multi_index(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One table over several, with the name of its source in ``_index``."""
    named = [df.withColumn("_index", F.lit(name)) for name, df in tables.items()]
    union = named[0]
    for part in named[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union


def boost_indices(hits: DataFrame, boosts: Mapping[str, float], score: str = "score") -> DataFrame:
    """Scores multiplied by the factor of their index; an unnamed index keeps its score."""
    factor = F.lit(1.0)
    for name, value in boosts.items():
        factor = F.when(F.col("_index") == name, F.lit(float(value))).otherwise(factor)
    return hits.withColumn(score, F.col(score) * factor)


def reindex(source: DataFrame, transform=None, clause: Column | None = None) -> DataFrame:
    """Copy of an index, filtered and changed on the way."""
    kept = source if clause is None else source.filter(clause)
    return kept if transform is None else kept.transform(transform)


def scripted_field(docs: DataFrame, **scripts: str) -> DataFrame:
    """A new column per script, each a SQL expression over the document's fields."""
    return docs.select("*", *[F.expr(code).alias(name) for name, code in scripts.items()])


def template_query(spark, text: str, tables: Mapping[str, DataFrame], **values) -> DataFrame:
    """A SQL text with ``:name`` parameters and ``{table}`` names filled in."""
    return spark.sql(text, args=values, **tables)


def ingest(docs: DataFrame, steps: Sequence[Mapping]) -> DataFrame:
    """Apply an ordered list of document transforms, each ``{"step": name, ...}``."""
    for step in steps:
        kind, field = step["step"], step.get("field")
        if kind == "remove":
            docs = docs.drop(field)
        elif kind == "rename":
            docs = docs.withColumnRenamed(field, step["to"])
        else:
            docs = docs.withColumn(step.get("to", field), _ingest_value(kind, F.col(field) if field in docs.columns else None, step))
    return docs


def _ingest_value(kind: str, value: Column | None, step: Mapping) -> Column:
    if kind == "set":
        return F.lit(step["value"])
    if kind == "lowercase":
        return F.lower(value)
    if kind == "trim":
        return F.trim(value)
    if kind == "split":
        return F.split(value, step["separator"])
    if kind == "join":
        return F.array_join(value, step["separator"])
    if kind == "gsub":
        return F.regexp_replace(value, step["pattern"], step["replacement"])
    if kind == "convert":
        return value.try_cast(step["type"])
    if kind == "date":
        return F.try_to_timestamp(value, F.lit(step["format"]))
    raise ValueError(f"unknown step {kind!r}")
