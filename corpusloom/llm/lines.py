"""Repeated lines, found by sorted runs of line hashes; decisions are bitmaps per document.

Every text is split at ``\\n``.  A line's key is the line without the characters ``\\x20\\x09-\\x0D`` at its ends, A-Z in
lower case.  A key of at least ``least`` code points that is in two documents or more keeps its lines only in the
smallest doc_id that has it.

Only (hash, document, position) rows move.  They are cut into ranges of the hash and sorted by hash, document and
position inside a range, and the first document of a hash streams along its run.  Hash values are spread evenly, so
equal ranges are even, but for hashes that very many rows share: a hash with more than one in ``HOT`` of all rows (there
are at most ``HOT`` of them, so a broadcast of them is bounded) gets its first document from a partial minimum instead,
and its rows never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.binding import let
from corpusloom.llm.work import store

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = 10
HOT = 1000
BITS = 60  # positions per word of a bitmap; the words stay positive


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _identity() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]


def line_rows(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(h1, h2, doc_id, text_hash, place) of every line whose key is long enough; the key has a 96-bit hash."""
    # the hash is made below the explode: beside it, every line would carry and hash the whole text
    whole = docs.select(*_identity(), split_lines(F.col("text").cast("string")).alias("lines"))
    lines = whole.select("doc_id", "text_hash", F.posexplode("lines").alias("place", "line"))
    keyed = lines.select("doc_id", "text_hash", "place", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= least).select(
        F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "doc_id", "text_hash", "place"
    )


def _later(rows: DataFrame) -> DataFrame:
    """Rows after the first document of their key."""
    order = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))
    rows = rows.withColumn("_at", order)
    total = F.greatest(F.lit(1), F.count(F.lit(1)))
    limit = rows.agg(F.ceil(total / HOT).cast("long").alias("n")).first()["n"]
    hot = (
        rows.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
        .filter(F.col("_n") > limit)
        .drop("_n")
    )
    marked = rows.join(F.broadcast(store(hot, "frequent-lines")), ["h1", "h2"], "left")
    of_hot = marked.filter("_first is not null")
    partitions = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    runs = Window.partitionBy("h1", "h2").orderBy("_at", "place")
    streamed = (
        marked.filter("_first is null")
        .drop("_first")
        .repartitionByRange(int(partitions), "h1", "h2")
        .withColumn("_first", F.first("_at").over(runs.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    return of_hot.unionByName(streamed).filter(F.col("_at") > F.col("_first"))


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, text_hash, n_dropped, words) of every document that loses a line.

    ``words`` is the compressed keep bitmap: an array of (word, bits) for those runs of 60 lines in which a line goes,
    where bit i of ``bits`` says that line ``60 * word + i`` stays; a word that is absent keeps all its lines.
    """
    rows = store(line_rows(docs, least), "line-hashes")
    drops = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % BITS)).alias("_drops")
    words = (
        _later(rows)
        .withColumn("word", F.floor(F.col("place") / BITS).cast("int"))
        .groupBy("doc_id", "text_hash", "word")
        .agg(drops)
    )
    bits = F.bitwise_not("_drops").bitwiseAND(F.lit(2**BITS - 1))
    return (
        words.groupBy("doc_id", "text_hash")
        .agg(
            F.sum(F.bit_count("_drops")).cast("long").alias("n_dropped"),
            F.collect_list(F.struct("word", bits.alias("bits"))).alias("words"),
        )
    )


def _kept_lines(lines: Column, words: Column) -> Column:
    """The lines that stay, in one walk: per word of the bitmap the untouched lines before it and its own kept lines."""

    def end(word: Column) -> Column:
        return BITS * (word["word"] + 1)

    def run(word: Column, i: Column) -> Column:
        before = F.coalesce(end(F.get(words, i - 1)), F.lit(0))
        begin = BITS * word["word"]
        own = F.filter(F.slice(lines, begin + 1, F.lit(BITS)), lambda _, j: F.getbit(word["bits"], j) == 1)
        return F.concat(F.slice(lines, before + 1, begin - before), own)

    last = end(F.element_at(words, -1))
    rest = F.slice(lines, last + 1, F.greatest(F.lit(0), F.size(lines) - last))
    return F.flatten(F.concat(F.transform(words, run), F.array(rest)))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cut to the kept lines, and the new columns n_lines and n_dropped.

    A document whose bitmap drops nothing keeps its text as it is, null included.  A column of ``docs`` that is called
    n_lines or n_dropped is replaced.
    """
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    tagged = docs.select(*[F.col(c) for c in others], *[c.alias(f"_{i}") for i, c in enumerate(_identity())])
    marks = bitmaps.select(
        F.col("doc_id").alias("_m"),
        F.col("text_hash").alias("_1"),
        F.col("n_dropped").alias("_dropped"),
        F.sort_array("words").alias("_words"),
    )
    # null ids are equal here; joined on a second column too, so that they do not all meet in one task
    same = F.col("_0").eqNullSafe(F.col("_m")) & (tagged["_1"] == marks["_1"])
    joined = tagged.join(marks, same, "left")
    kept = F.array_join(let(split_lines(F.col("text").cast("string")), lambda own: _kept_lines(own, F.col("_words"))), "\n")
    lines = F.size(split_lines(F.col("text").cast("string")))
    text = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(kept)
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in others],
        lines.cast("long").alias("n_lines"),
        F.coalesce("_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` without the repeated lines, plus n_lines (before) and n_dropped.

    Documents with a null doc_id count as one document that comes after all others.  Rows that repeat a doc_id are one
    document: their common lines stay in each.  A null text has one empty line and stays null.  An empty table gives an
    empty table.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs, least))
