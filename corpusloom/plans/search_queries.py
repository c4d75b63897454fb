"""Search-side queries over documents, benchmark texts, orders and parts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import live_index, multisearch, search
from corpusloom.plans.registry import query, quoted, sql_list, table
from corpusloom.sources import tables
from corpusloom.session import work_path

WORDS = "Ing les der thion"
TERMS = tx.terms_of(WORDS)
PATTERN = quoted(tx.token_pattern())
STOP = sql_list(tx.STOP_WORDS)


def sql_terms(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), {PATTERN}), lambda t: t NOT IN {STOP})"


def sql_bm25(tf="tf", length="length", df="df", n="n_docs", avg="avg_length") -> str:
    return (
        f"ln(1.0 + ({n} - {df} + 0.5) / ({df} + 0.5)) * {tf} * 2.2 "
        f"/ ({tf} + 1.2 * (1.0 - 0.75 + 0.75 * {length} / {avg}))"
    )


def sql_index(fields: dict[str, str], source: str, id_col: str) -> str:
    """CTEs ft, stats, postings, freq for the fields of one table."""
    rows = " UNION ALL ".join(
        f"SELECT {id_col} AS _id, {quoted(name)} AS field, {sql_terms(expr)} AS terms FROM {source}"
        for name, expr in fields.items()
    )
    return f"""ft AS ({rows}),
    stats AS (SELECT field, count(*) AS n_docs, avg(len(terms)) AS avg_length FROM ft GROUP BY field),
    postings AS (SELECT _id, field, term, count(*) AS tf, any_value(length) AS length
      FROM (SELECT _id, field, len(terms) AS length, unnest(terms) AS term FROM ft) GROUP BY _id, field, term),
    freq AS (SELECT field, term, count(*) AS df FROM postings GROUP BY field, term)"""


def documents(spark, sf):
    return tables.spread(table(spark, sf, "documents"))


def document_index(spark, sf, *fields):
    """The documents' index, stored and read back as it is for many searches."""
    path = work_path(spark, "index")
    search.write_index(documents(spark, sf), fields or ("text",), path, "doc_id")
    return search.read_index(spark, path)


@query(
    "search_bm25",
    f"""WITH {sql_index({'text': 'text'}, 'documents', 'doc_id')}
    SELECT _id, round(sum({sql_bm25()}), 6) AS score
    FROM postings JOIN freq USING (field, term) JOIN stats USING (field)
    WHERE term IN {sql_list(TERMS)} GROUP BY _id ORDER BY score DESC, _id LIMIT 10""",
)
def search_bm25(spark, sf):
    return search.scan_search(documents(spark, sf), "doc_id", "text", WORDS, 10)


@query(
    "search_boosted_fields",
    f"""WITH {sql_index({'text': 'text', 'source': 'source'}, 'documents', 'doc_id')}
    SELECT _id, round(sum((CASE field WHEN 'source' THEN 2.0 ELSE 1.0 END) * {sql_bm25()}), 6) AS score
    FROM postings JOIN freq USING (field, term) JOIN stats USING (field)
    WHERE term IN {sql_list([*TERMS, 'src1'])} GROUP BY _id ORDER BY score DESC, _id LIMIT 20 OFFSET 5""",
)
def search_boosted_fields(spark, sf):
    index = document_index(spark, sf, "text", "source")
    return search.search(index, WORDS + " src1", size=20, offset=5, boosts={"source": 2.0})


@query(
    "search_lazy_index",
    f"""WITH {sql_index({'text': 'text'}, 'documents', 'doc_id')}
    SELECT _id, round(sum({sql_bm25()}), 6) AS score
    FROM postings JOIN freq USING (field, term) JOIN stats USING (field)
    WHERE term IN {sql_list(TERMS)} GROUP BY _id ORDER BY score DESC, _id LIMIT 25""",
)
def search_lazy_index(spark, sf):
    return search.search(search.build_index(documents(spark, sf), ["text"], "doc_id"), WORDS, size=25)


@query(
    "msearch_topk",
    f"""WITH {sql_index({'text': 'text'}, 'documents', 'doc_id')},
    q AS (SELECT DISTINCT qid, term FROM (SELECT item_id AS qid, unnest({sql_terms('text')}) AS term FROM benchmark)),
    s AS (SELECT qid, _id, round(sum({sql_bm25()}), 6) AS score
      FROM q JOIN postings USING (term) JOIN freq USING (field, term) JOIN stats USING (field) GROUP BY qid, _id)
    SELECT qid, CAST(rank AS INTEGER) AS rank, _id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, _id) AS rank FROM s) WHERE rank <= 5""",
)
def msearch_topk(spark, sf):
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return multisearch.msearch(document_index(spark, sf), queries, 5)


@query(
    "msearch_mixed",
    f"""WITH {sql_index({'text': 'text', 'source': 'source'}, 'documents', 'doc_id')},
    b AS (SELECT item_id AS qid, left(text, 60) || ' src1' AS query, CASE WHEN item_id % 5 > 0 THEN item_id % 5 ELSE 4 END AS size, item_id % 3 AS skip, item_id % 2 = 0 AS only_text FROM benchmark),
    q AS (SELECT DISTINCT qid, size, skip, only_text, term FROM (SELECT *, unnest({sql_terms('query')}) AS term FROM b)),
    s AS (SELECT qid, size, skip, _id, round(sum({sql_bm25()}), 6) AS score
      FROM q JOIN postings USING (term) JOIN freq USING (field, term) JOIN stats USING (field)
      WHERE field = 'text' OR NOT only_text GROUP BY qid, size, skip, _id)
    SELECT qid, CAST(rank AS INTEGER) AS rank, _id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, _id) AS rank FROM s) WHERE rank > skip AND rank <= skip + size""",
)
def msearch_mixed(spark, sf):
    """Queries that differ in size, offset and fields."""
    n = F.col("item_id")
    queries = table(spark, sf, "benchmark").select(
        n.alias("qid"),
        F.concat(F.left("text", F.lit(60)), F.lit(" src1")).alias("query"),
        F.when(n % 5 > 0, n % 5).alias("size"),
        (n % 3).alias("offset"),
        F.when(n % 2 == 0, F.array(F.lit("text"))).alias("fields"),
    )
    return multisearch.msearch(document_index(spark, sf, "text", "source"), queries, 4)


@query(
    "doc_freq",
    f"""SELECT 'text' AS field, term, count(DISTINCT doc_id) AS df
    FROM (SELECT doc_id, unnest({sql_terms('text')}) AS term FROM documents) GROUP BY term""",
)
def doc_freq(spark, sf):
    return search.term_documents(documents(spark, sf), "doc_id", ["text"])


@query(
    "field_stats",
    f"""WITH {sql_index({'text': 'text', 'lang': 'lang'}, 'documents', 'doc_id')}
    SELECT field, n_docs, round(avg_length, 6) AS avg_length FROM stats""",
)
def field_stats(spark, sf):
    return search.field_stats(documents(spark, sf), "doc_id", ["text", "lang"]).withColumn("avg_length", F.round("avg_length", 6))


@query(
    "match_terms",
    f"""SELECT doc_id, lang FROM documents
    WHERE len(list_filter({sql_terms('text')}, lambda t: t IN {sql_list(TERMS)})) > 0""",
)
def match_terms(spark, sf):
    return search.match(documents(spark, sf), "text", WORDS).select("doc_id", "lang")


@query(
    "match_index",
    f"""SELECT doc_id, lang FROM documents WHERE list_contains({sql_terms('text')}, 'ing') AND list_contains({sql_terms('text')}, 'les')
    UNION ALL SELECT doc_id, 'any' FROM documents WHERE len(list_filter({sql_terms('text')}, lambda t: t IN {sql_list(TERMS)})) > 0""",
)
def match_index(spark, sf):
    """Matching documents by the stored postings: all of two terms, and any of the usual ones."""
    docs, index = documents(spark, sf), document_index(spark, sf)
    every = search.match_index(docs, index, "ing les", "text", "and", "doc_id").select("doc_id", "lang")
    return every.unionByName(search.match_index(docs, index, WORDS, "text", "or", "doc_id").select("doc_id", F.lit("any").alias("lang")))


_CHANGED = """(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN lang || ' thion ' || source || ' les ' || substring(text, 1, 200) ELSE text END AS text FROM documents
    WHERE doc_id % 7 <> 3)"""
_LIVE_SQL = f"""WITH {sql_index({'text': 'text'}, _CHANGED, 'doc_id')}
    SELECT _id, round(sum({sql_bm25()}), 6) AS score
    FROM postings JOIN freq USING (field, term) JOIN stats USING (field)
    WHERE term IN {sql_list(TERMS)} GROUP BY _id ORDER BY score DESC, _id LIMIT 30"""


def changed_index(spark, sf, together: bool):
    """An index of all documents, in which every fifth one is replaced and every seventh one deleted, in one or two steps."""
    path, docs = work_path(spark, "live-index"), documents(spark, sf).select("doc_id", "text", "lang", "source")
    live_index.change(spark, path, docs, ["text"], id_col="doc_id")
    text = F.concat("lang", F.lit(" thion "), "source", F.lit(" les "), F.substring("text", 1, 200))
    new, gone = docs.filter("doc_id % 5 = 0").withColumn("text", text), docs.filter("doc_id % 7 = 3")
    if together:
        live_index.change(spark, path, new.filter("doc_id % 7 <> 3"), ["text"], gone, id_col="doc_id")
    else:
        live_index.change(spark, path, new, ["text"], id_col="doc_id")
        live_index.change(spark, path, deletes=gone, id_col="doc_id")
    return path


@query("index_upsert_search", _LIVE_SQL)
def index_upsert_search(spark, sf):
    return search.search(live_index.read_index(spark, changed_index(spark, sf, True)), WORDS, size=30)


@query("index_delete_search", _LIVE_SQL)
def index_delete_search(spark, sf):
    return search.search(live_index.read_index(spark, changed_index(spark, sf, False)), WORDS, size=30)


@query("index_created_and_deleted", "SELECT doc_id, lang, true AS was_there, false AS is_there FROM documents WHERE lang IS NOT NULL")
def index_created_and_deleted(spark, sf):
    """A declared index takes documents, is scanned by its name, and goes; its files stay readable by their path."""
    docs, path = table(spark, sf, "documents").select("doc_id", "lang"), work_path(spark, "declared")
    name = "declared_" + path[-32:]
    tables.create_index(spark, name, docs.schema, path)
    docs.write.insertInto(name)
    was = tables.scan_all(spark, name, F.col("lang").isNotNull()).count() > 0
    tables.delete_index(spark, name)
    gone = spark.catalog.tableExists(name)
    return spark.read.parquet(path).filter("lang is not null").select("doc_id", "lang", F.lit(was).alias("was_there"), F.lit(gone).alias("is_there"))


_LAST_WRITE = """(SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'thion ' || text ELSE text END AS text FROM documents
    WHERE doc_id % 9 <> 5)"""


@query("index_merge_parts", _LIVE_SQL.replace(_CHANGED, _LAST_WRITE))
def index_merge_parts(spark, sf):
    """The search over an index that four changes have built and merged: parts of the documents, upserts, deletions."""
    path, docs = work_path(spark, "merged-index"), documents(spark, sf).select("doc_id", "text")
    put = lambda rows, gone=None: live_index.change(spark, path, rows, ["text"], gone, id_col="doc_id")
    put(docs.filter("doc_id % 2 = 0"))
    put(docs.filter("doc_id % 3 = 1").withColumn("text", F.concat(F.lit("thion "), "text")))
    put(docs.filter("doc_id % 2 = 1 and doc_id % 3 <> 1"))
    live_index.change(spark, path, deletes=docs.filter("doc_id % 9 = 5"), id_col="doc_id")
    return search.search(live_index.read_index(spark, path), WORDS, size=30)


@query(
    "snippet_from_offsets",
    f"""WITH RECURSIVE w AS (SELECT doc_id, text, ' ' || regexp_replace(lower(text), '[^{tx.WORD}]', ' ', 'g') || ' ' AS t FROM documents),
    h AS (SELECT doc_id, t, term, strpos(t, ' ' || term || ' ') AS spot FROM w, (SELECT unnest({sql_list(TERMS).replace('(', '[').replace(')', ']')}) AS term)),
    p AS (SELECT * FROM h WHERE spot > 0 UNION ALL
      SELECT doc_id, t, term, spot + strpos(substring(t, spot + 1), ' ' || term || ' ') FROM p WHERE strpos(substring(t, spot + 1), ' ' || term || ' ') > 0),
    o AS (SELECT doc_id, term, spot - 1 AS a, spot - 1 + length(term) AS b FROM p),
    k AS (SELECT x.doc_id, x.a, e.b AS till, count(DISTINCT y.term) AS terms FROM o x JOIN o e ON e.doc_id = x.doc_id AND e.a >= x.a AND e.b - x.a <= 60
      JOIN o y ON y.doc_id = x.doc_id AND y.a >= x.a AND y.b <= e.b GROUP BY ALL),
    r AS (SELECT doc_id, a, terms FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY terms DESC, till - a, a) = 1)
    SELECT doc_id, substring(text, a + 1, 60) AS plain, a::BIGINT AS start, terms::INTEGER AS terms FROM r JOIN documents USING (doc_id)""",
)
def snippet_from_offsets(spark, sf):
    path, docs = work_path(spark, "snippet-index"), documents(spark, sf).select("doc_id", "text")
    live_index.change(spark, path, docs, ["text"], id_col="doc_id")
    found = live_index.snippets(live_index.live_postings(spark, path), docs, WORDS, "text", 60, "doc_id")
    return found.select("doc_id", F.regexp_replace("snippet", "</?em>", "").alias("plain"), "start", "terms")


@query(
    "phrase_match",
    f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), {PATTERN}) AS t FROM documents),
    p AS (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM d WHERE len(t) > 1)
    SELECT doc_id AS _id, count(*) AS n FROM p WHERE t[i] = 'en' AND t[i + 1] = 'er' GROUP BY doc_id""",
)
def phrase_match(spark, sf):
    """Documents with a phrase from the stored positions; a stop word between two words holds its place only."""
    path = work_path(spark, "live-index")
    live_index.change(spark, path, documents(spark, sf), ["text"], id_col="doc_id")
    found = live_index.phrase_match(live_index.live_postings(spark, path), "en er", "text")
    return found.groupBy("_id").agg(F.count(F.lit(1)).alias("n"))


_CLAUSE = lambda f, words: f"(field = '{f}' AND term IN {sql_list(words)})"


@query(
    "bool_scored",
    f"""WITH {sql_index({'text': 'text', 'source': 'source'}, 'documents', 'doc_id')},
    w AS (SELECT _id, field, term, {sql_bm25()} AS weight FROM postings JOIN freq USING (field, term) JOIN stats USING (field)),
    d AS (SELECT _id, sum(CASE WHEN {_CLAUSE('text', ['ing'])} OR {_CLAUSE('text', ['les', 'thion'])} OR {_CLAUSE('source', ['src1', 'src2'])} THEN weight ELSE 0 END) AS score,
        bool_or({_CLAUSE('text', ['ing'])}) AS a, bool_or({_CLAUSE('text', ['les', 'thion'])}) AS b, bool_or({_CLAUSE('source', ['src1', 'src2'])}) AS c,
        bool_or({_CLAUSE('text', ['der'])}) AS n, bool_or({_CLAUSE('text', ['on', 'en', 'er', 'st', 'eres'])}) AS f FROM w GROUP BY _id)
    SELECT _id, round(score, 6) AS score FROM d WHERE a AND f AND NOT n AND (b OR c) ORDER BY score DESC, _id LIMIT 15""",
)
def bool_scored(spark, sf):
    """Clauses over two fields: scores of must and should add up, filter and must_not score nothing."""
    return search.bool_scored(
        document_index(spark, sf, "text", "source"),
        must=[("text", "Ing")],
        should=[("text", "les thion"), ("source", "src1 src2")],
        must_not=[("text", "der")],
        filter=[("text", "on en er st eres")],
        minimum_should_match=1,
        size=15,
    )


@query(
    "match_all_terms",
    f"""WITH d AS (SELECT doc_id, {sql_terms('text')} AS terms FROM documents)
    SELECT doc_id FROM d WHERE list_contains(terms, 'ing') AND list_contains(terms, 'eres')""",
)
def match_all_terms(spark, sf):
    return search.match(documents(spark, sf), "text", "ing eres", "and").select("doc_id")


@query(
    "term_vectors",
    f"""WITH lo AS (SELECT doc_id, lower(text) AS t FROM documents),
    a AS (SELECT doc_id, regexp_extract_all(t, {PATTERN}) AS toks, string_split_regex(t, {PATTERN}) AS gaps FROM lo),
    u AS (SELECT doc_id, unnest(toks) AS term, unnest(gaps[1:len(toks)]) AS gap, unnest(range(len(toks))) AS pos FROM a),
    p AS (SELECT doc_id, term, pos, sum(length(gap) + length(term)) OVER (
        PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS e FROM u)
    SELECT doc_id, term, count(*) AS tf, CAST(sum(pos) AS BIGINT) AS pos_sum,
      CAST(min(e - length(term)) AS BIGINT) AS first_start, CAST(max(e) AS BIGINT) AS last_end
    FROM p WHERE term NOT IN {STOP} GROUP BY doc_id, term""",
)
def term_vectors(spark, sf):
    rows = search.analyze(documents(spark, sf), "doc_id", ["text"])
    return rows.groupBy("doc_id", "term").agg(
        F.count(F.lit(1)).alias("tf"),
        F.sum("pos").alias("pos_sum"),
        F.min("start").cast("long").alias("first_start"),
        F.max("end").cast("long").alias("last_end"),
    )


DICTIONARY = ["甲乙", "甲乙丙", "丁戊"]
LETTERS, SIGNS = "abcdefghijklmnopqrstuvwxyz", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄"


@query(
    "cjk_terms",
    f"""SELECT p_partkey, term FROM (
      SELECT p_partkey, unnest(regexp_extract_all(translate(lower(p_name), '{LETTERS}', '{SIGNS}'),
        '甲乙丙|甲乙|丁戊|[{tx.WORD}]+|[一-龥]')) AS term FROM part) WHERE term NOT IN {STOP}""",
)
def cjk_terms(spark, sf):
    name = F.translate(F.lower("p_name"), LETTERS, SIGNS)
    return table(spark, sf, "part").select("p_partkey", F.explode(tx.terms(name, dictionary=DICTIONARY)).alias("term"))


_CJK_NAMES = f"SELECT p_partkey, translate(lower(p_name), '{LETTERS}', '{SIGNS}') AS name FROM part"


@query(
    "dictionary_terms",
    f"""WITH names AS ({_CJK_NAMES}),
    dict AS (SELECT DISTINCT unnest([substring(name, 1, 2), substring(name, 2, 3), substring(name, 5, 4)]) AS word FROM names),
    pattern AS (SELECT string_agg(word, '|' ORDER BY length(word) DESC, word) || '|[{tx.WORD}]+|[一-龥]' AS p FROM dict WHERE trim(word) <> ''),
    stop AS (SELECT translate(lower(n_name), '{LETTERS}', '{SIGNS}')[1:2] AS word FROM nation)
    SELECT p_partkey, term FROM (SELECT p_partkey, unnest(regexp_extract_all(name, p)) AS term FROM names, pattern)
    WHERE term NOT IN (SELECT word FROM stop)""",
)
def dictionary_terms(spark, sf):
    """Part names in CJK signs, with a dictionary made of pieces of all names and stop words made of nation names."""
    signs = lambda name: F.translate(F.lower(name), LETTERS, SIGNS)
    names = table(spark, sf, "part").select("p_partkey", signs("p_name").alias("name"))
    pieces = F.array(F.substring("name", 1, 2), F.substring("name", 2, 3), F.substring("name", 5, 4))
    words = names.select(F.explode(pieces).alias("word")).filter(F.trim("word") != "")
    stop = table(spark, sf, "nation").select(F.substring(signs("n_name"), 1, 2).alias("word"))
    found = search.dictionary_terms(names, "p_partkey", "name", words, stop)
    return found.select("p_partkey", F.explode("terms").alias("term"))


@query(
    "range_date",
    """SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30'""",
)
def range_date(spark, sf):
    day = search.between(F.col("o_orderdate"), dt.datetime(1996, 1, 1), dt.datetime(1997, 6, 30))
    return table(spark, sf, "orders").filter(day).select("o_orderkey", "o_totalprice")


@query(
    "bool_query",
    f"""WITH d AS (SELECT doc_id, lang, source, n_chars, {sql_terms('text')} AS terms FROM documents),
    c AS (SELECT *, CAST(source = 'src1' AS INT) + CAST(n_chars > 1500 AS INT) AS hits FROM d)
    SELECT doc_id, CAST(1 + hits AS DOUBLE) AS score FROM c
    WHERE list_contains(terms, 'ing') AND n_chars >= 200 AND lang <> 'de' AND hits >= 1""",
)
def bool_query(spark, sf):
    hits = search.bool_query(
        documents(spark, sf),
        must=[search.matches(F.col("text"), "ing")],
        should=[search.term(F.col("source"), "src1"), F.col("n_chars") > 1500],
        must_not=[F.col("lang") == "de"],
        filter=[search.between(F.col("n_chars"), 200)],
        minimum_should_match=1,
    )
    return hits.select("doc_id", "score")


@query(
    "missing_label",
    "SELECT doc_id, lang FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL",
)
def missing_label(spark, sf):
    joined = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.filter(search.missing(F.col("quality"))).select("doc_id", "lang")


@query("count_matching", "SELECT count(*) AS count FROM documents WHERE lang = 'fr'")
def count_matching(spark, sf):
    return search.count(documents(spark, sf), F.col("lang") == "fr")


@query("count_total", "SELECT count(*) AS count FROM documents")
def count_total(spark, sf):
    return search.count(documents(spark, sf))


@query(
    "percolate",
    f"""WITH sent AS (SELECT item_id, unnest(string_split(text, '.')) AS s, unnest(range(len(string_split(text, '.')))) AS n FROM benchmark),
    q AS (SELECT DISTINCT item_id * 1000 + n AS qid, term FROM (SELECT item_id, n, unnest({sql_terms('s')}) AS term FROM sent)),
    need AS (SELECT qid, count(*) AS n FROM q GROUP BY qid),
    d AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({sql_terms('text')}) AS term FROM documents))
    SELECT doc_id, qid FROM (SELECT doc_id, qid, count(*) AS got FROM d JOIN q USING (term) GROUP BY doc_id, qid)
    JOIN need USING (qid) WHERE got = n""",
)
def percolate(spark, sf):
    sentences = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", r"\.")).alias("n", "query"))
    queries = sentences.select((F.col("item_id") * 1000 + F.col("n")).alias("qid"), "query")
    return search.percolate(documents(spark, sf), queries)


@query(
    "snippet",
    f"""WITH m AS (SELECT doc_id, text, ' ' || regexp_replace(lower(text), '[^{tx.WORD}]', ' ', 'g') || ' ' AS t FROM documents),
    p AS (SELECT doc_id, text, list_min(list_filter([{', '.join(f"strpos(t, ' {w} ')" for w in TERMS)}], lambda x: x > 0)) AS spot FROM m),
    s AS (SELECT doc_id, text, spot, greatest(spot - 30, 1) AS st FROM p WHERE spot IS NOT NULL)
    SELECT doc_id, regexp_replace(substring(text, st, 60), '$', '') AS plain, CAST(st - 1 AS BIGINT) AS start FROM s""",
)
def snippet(spark, sf):
    docs = documents(spark, sf)
    hits = search.match(docs, "text", WORDS)
    found = search.snippets(hits, docs, "text", WORDS, 60, "doc_id")
    return found.select("doc_id", F.regexp_replace("snippet", "</?em>", "").alias("plain"), "start")


@query(
    "boosted_multi_index",
    f"""WITH docs AS (SELECT doc_id AS id, text, 'documents' AS _index FROM documents
      UNION ALL SELECT conv_id * 1000 + turn, text, 'conversations' FROM conversations),
    t AS (SELECT id, _index, {sql_terms('text')} AS terms FROM docs),
    st AS (SELECT _index, count(*) AS n_docs, avg(len(terms)) AS avg_length FROM t GROUP BY _index),
    p AS (SELECT id, _index, term, count(*) AS tf, any_value(l) AS length FROM
      (SELECT id, _index, len(terms) AS l, unnest(terms) AS term FROM t) WHERE term IN {sql_list(TERMS)} GROUP BY ALL),
    f AS (SELECT _index, term, count(*) AS df FROM p GROUP BY ALL),
    s AS (SELECT _index, id AS _id, round(sum({sql_bm25()}), 6) AS score FROM p JOIN f USING (_index, term) JOIN st USING (_index) GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY _index ORDER BY score DESC, _id) AS r FROM s)
    SELECT _index, _id, round(score * CASE _index WHEN 'conversations' THEN 1.5 ELSE 1.0 END, 5) AS score FROM k WHERE r <= 20""",
)
def boosted_multi_index(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    hits = search.multi_index(
        {
            "documents": search.scan_search(documents(spark, sf), "doc_id", "text", WORDS, 20),
            "conversations": search.scan_search(turns, "id", "text", WORDS, 20),
        }
    )
    boosted = search.boost_indices(hits, {"conversations": 1.5})
    return boosted.select("_index", "_id", F.round("score", 5).alias("score"))


@query(
    "multi_index_scan",
    """SELECT _index, count(*) AS n, count(lang) AS with_lang FROM (
      SELECT 'documents' AS _index, text, lang FROM documents
      UNION ALL SELECT 'benchmark', text, NULL FROM benchmark) GROUP BY _index""",
)
def multi_index_scan(spark, sf):
    rows = search.multi_index({"documents": documents(spark, sf), "benchmark": table(spark, sf, "benchmark")})
    return rows.groupBy("_index").agg(F.count(F.lit(1)).alias("n"), F.count("lang").alias("with_lang"))


@query(
    "parents_with_children",
    """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (
      SELECT l_orderkey FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey HAVING count(*) >= 3)""",
)
def parents_with_children(spark, sf):
    children = table(spark, sf, "lineitem").filter("l_quantity > 25")
    return search.has_child(table(spark, sf, "orders"), children, "o_orderkey", "l_orderkey", 3).select(
        "o_orderkey", "o_orderstatus"
    )


@query(
    "children_of_parents",
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (
      SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def children_of_parents(spark, sf):
    parents = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return search.has_parent(table(spark, sf, "lineitem"), parents, "l_orderkey", "o_orderkey").select(
        "l_orderkey", "l_linenumber"
    )


@query(
    "children_per_bucket",
    """SELECT o_orderpriority, l_returnflag, count(*) AS children, count(DISTINCT o_orderkey) AS parents
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderpriority, l_returnflag""",
)
def children_per_bucket(spark, sf):
    return search.child_counts(
        table(spark, sf, "orders"), table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey", "l_returnflag", "o_orderpriority"
    )


_MATRIX = ["l_discount", "l_extendedprice", "l_quantity"]


def _matrix_sql() -> str:
    # population moments as the textbook defines them, from two passes
    m = ", ".join(f"avg({c}) AS m_{c}" for c in _MATRIX)
    moments = ", ".join(f"avg(({c} - m_{c})**{k}) AS m{k}_{c}" for c in _MATRIX for k in (2, 3, 4))
    rows = " UNION ALL ".join(
        f"""SELECT {quoted(a)} AS field, {quoted(b)} AS other, n AS count, round(mean_{a}, 4) AS mean,
        round(var_{a}, 3) AS variance, round(m3_{a} / m2_{a}**1.5, 5) AS skewness,
        round(m4_{a} / m2_{a}**2 - 3, 5) AS kurtosis, round(cov_{a}_{b}, 2) AS covariance, round(corr_{a}_{b}, 5) AS correlation
        FROM g"""
        for a in _MATRIX
        for b in _MATRIX
        if a <= b
    )
    base = ", ".join(
        [f"avg({c}) AS mean_{c}, var_samp({c}) AS var_{c}" for c in _MATRIX]
        + [f"covar_samp({a}, {b}) AS cov_{a}_{b}, corr({a}, {b}) AS corr_{a}_{b}" for a in _MATRIX for b in _MATRIX if a <= b]
    )
    return f"""WITH mm AS (SELECT {m} FROM lineitem),
    g AS (SELECT count(*) AS n, {base}, {moments} FROM lineitem, mm) {rows}"""


@query("matrix_stats", _matrix_sql())
def matrix_stats(spark, sf):
    made = search.matrix_stats(table(spark, sf, "lineitem"), _MATRIX)
    places = {"mean": 4, "variance": 3, "skewness": 5, "kurtosis": 5, "covariance": 2, "correlation": 5}
    return made.select("field", "other", "count", *[F.round(c, p).alias(c) for c, p in places.items()])


@query(
    "reindex_changed",
    "SELECT doc_id, upper(lang) AS lang, n_chars * 2 AS n_chars FROM documents WHERE source <> 'src1'",
)
def reindex_changed(spark, sf):
    return search.reindex(
        documents(spark, sf),
        lambda df: df.select("doc_id", F.upper("lang").alias("lang"), (F.col("n_chars") * 2).alias("n_chars")),
        F.col("source") != "src1",
    )


@query(
    "scripted_field",
    "SELECT o_orderkey, floor(o_totalprice) / 4 AS quarters, length(o_orderpriority) + o_custkey AS mixed FROM orders",
)
def scripted_field(spark, sf):
    made = search.scripted_field(
        table(spark, sf, "orders"),
        quarters="floor(o_totalprice) / 4",
        mixed="length(o_orderpriority) + o_custkey",
    )
    return made.select("o_orderkey", "quarters", "mixed")


@query(
    "template_query",
    """SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal >= 500.0 AND c_nationkey <> 3 GROUP BY c_mktsegment""",
)
def template_query(spark, sf):
    text = "SELECT c_mktsegment, count(*) AS n FROM {customers} WHERE c_acctbal >= :least AND c_nationkey <> :nation GROUP BY c_mktsegment"
    return search.template_query(spark, text, {"customers": table(spark, sf, "customer")}, least=500.0, nation=3)


@query(
    "ingest_steps",
    """SELECT p_partkey, lower(p_type) AS kind, replace(p_name, ' ', '-') AS p_name,
      array_to_string(string_split(p_brand, '#'), '/') AS p_brand, CAST(p_size AS VARCHAR) AS p_size, 'shop' AS origin FROM part""",
)
def ingest_steps(spark, sf):
    return search.ingest(
        table(spark, sf, "part"),
        [
            {"step": "remove", "field": "p_retailprice"},
            {"step": "rename", "field": "p_type", "to": "kind"},
            {"step": "lowercase", "field": "kind"},
            {"step": "gsub", "field": "p_name", "pattern": " ", "replacement": "-"},
            {"step": "trim", "field": "p_name"},
            {"step": "split", "field": "p_brand", "separator": "#"},
            {"step": "join", "field": "p_brand", "separator": "/"},
            {"step": "convert", "field": "p_size", "type": "string"},
            {"step": "set", "field": "origin", "value": "shop"},
        ],
    )


@query("scan_published", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 1000")
def scan_published(spark, sf):
    """A table version is written, named, and scanned through its name."""
    name = f"documents_{abs(hash(sf)) % 10**8}"
    tables.publish(documents(spark, sf).drop("text"), name, work_path(spark, "tables"))
    return tables.scan_all(spark, name, F.col("n_chars") > 1000).select("doc_id", "n_chars")
