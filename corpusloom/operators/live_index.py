"""A stored text index that takes upserts and deletes by id, and phrase search over positions.

Every change is a part: the positional postings of its documents, their lengths, the ids that it replaces or deletes, what
it takes away of earlier parts' document frequencies, and what changes in field statistics.  A version is a manifest of
parts in order; a posting is live if no later part of the version names its document.

Postings are blocks of a term (``functions/blocks.py``) in segments, slices of the documents that one task analyzed.  They
name documents by their number in the segment; the lengths tell whose it is.  A task writes its blocks sorted by term, so
a term is a few pages in each file and blocks are never shuffled.  What a change takes away is one row of bits per
segment that loses documents; a task that reads blocks holds those rows, a bit per document.

Parts are merged by size: when a part is not at least ``TIER`` times as large as all after it together, it is merged with
those.  So sizes fall by a factor from part to part, there are at most as many parts as the logarithm of the index's size
in base ``TIER``, and a document is rewritten as often at most.  A merge leaves out postings that a later part of the
merged ones replaces, and the ids of deletions once nothing is left that they could hide.  Readers stay on the manifest
they have read; the parts that no kept version names go with ``vacuum``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import blocks
from corpusloom.functions import text as tx
from corpusloom.operators.search import Index
from corpusloom.session import small_batches

TIER = 2
TEXTS_AT_ONCE = 64  # texts whose places a task holds as Python values
_FREQ = "field string, term string, df bigint"
_MANIFEST = "part string, place int, size bigint"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def last_version(spark: SparkSession, path: str) -> int:
    """The number of the last complete version, 0 if there is none."""
    if not _exists(spark, f"{path}/manifest"):
        return 0
    return spark.read.parquet(f"{path}/manifest").agg(F.max("version")).first()[0] or 0


def parts(spark: SparkSession, path: str, version: int | None = None) -> list[tuple[str, int]]:
    """(name, size) of a version's parts in order; as many as the logarithm of the index's size."""
    version = version or last_version(spark, path)
    if not version:
        return []
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/version={version}").orderBy("place").collect()
    return [(r["part"], r["size"]) for r in rows]


def _read(spark: SparkSession, path: str, names: Sequence[str], kind: str) -> DataFrame:
    """One kind of table of several parts, with the place of the part in their order."""
    rows = None
    for place, name in enumerate(names):
        table = spark.read.parquet(f"{path}/{name}/{kind}").withColumn("_place", F.lit(place))
        rows = table if rows is None else rows.unionByName(table)
    return rows


def _blocks(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Blocks of postings, dead ones among them; segments have other numbers in each part."""
    rows = None
    for name in names:
        table = spark.read.parquet(f"{path}/{name}/postings").filter("term is not null").select(*blocks.NAMES)
        rows = table if rows is None else rows.unionByName(table)
    return rows


def _lengths(spark: SparkSession, path: str, names: Sequence[str], live: bool = True) -> DataFrame:
    """(_id, field, length, segment, no) of the documents that no later part replaces, or of those that one does."""
    rows = _read(spark, path, names, "lengths")
    if len(names) == 1:
        return rows.drop("_place") if live else rows.drop("_place").limit(0)
    last = _read(spark, path, names, "gone").groupBy("_id").agg(F.max("_place").alias("_last"))
    joined = rows.join(last, "_id", "left")
    stays = F.col("_last").isNull() | (F.col("_place") >= F.col("_last"))
    return joined.filter(stays if live else ~stays).drop("_last", "_place")


def _write_marks(lengths: DataFrame, place: str) -> None:
    """(segment, bits) of the documents of some rows of lengths; document i is bit i % 8 of byte i / 8."""
    bits = F.call_function("bitmap_construct_agg", F.col("no").cast("long"))
    lengths.filter("segment is not null").groupBy("segment").agg(bits.substr(1, blocks.SEGMENT_DOCS // 8).alias("bits")).write.mode("overwrite").parquet(place)


def _marked_counts(spark: SparkSession, path: str, names: Sequence[str], marks: str) -> DataFrame:
    """(field, term, df): how many marked documents the blocks have, below zero."""
    return _blocks(spark, path, names).drop("places").mapInArrow(blocks.marked_counts(marks), _FREQ)


def _postings(spark: SparkSession, path: str, names: Sequence[str], unfolded: Column) -> DataFrame:
    """Live postings with the columns of the structs that a block unfolds to."""
    rows = _blocks(spark, path, names).select("segment", "field", "term", F.explode(unfolded).alias("_doc")).select("segment", "field", "term", "_doc.*")
    return rows.join(_lengths(spark, path, names).filter("segment is not null"), ["segment", "no", "field"])


def live_postings(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(_id, field, term, tf, length, places<pos, start, end>) of the documents as they are at a version."""
    unfolded = blocks.postings(F.col("term"), F.col("n"), F.col("docs"), F.col("places"))
    rows = _postings(spark, path, [name for name, _ in parts(spark, path, version)], unfolded)
    return rows.select("_id", "field", "term", "tf", "length", "places")


def _freq(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """(field, term, df): the sizes of the blocks, and what the parts take away of earlier ones."""
    rows = _blocks(spark, path, names).select("field", "term", F.col("n").cast("long").alias("df"))
    rows = rows.unionByName(_read(spark, path, names, "freq").drop("_place"))
    return rows.groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df <> 0")


def _stats(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    rows = _read(spark, path, names, "stats")
    return rows.groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("total").alias("total"))


def read_index(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The index at a version, for every search that takes one."""
    names = [name for name, _ in parts(spark, path, version)]
    stats = _stats(spark, path, names).select("field", "n_docs", (F.col("total") / F.col("n_docs")).alias("avg_length"))
    postings = _postings(spark, path, names, blocks.documents(F.col("n"), F.col("docs"))).select("_id", "field", "term", "tf", "length")
    return Index(postings, stats, _freq(spark, path, names))


def _field_stats(lengths: DataFrame, sign: int) -> DataFrame:
    return lengths.groupBy("field").agg(
        (F.count(F.lit(1)) * sign).cast("long").alias("n_docs"), (F.sum("length") * sign).cast("long").alias("total")
    )


def _write_blocks(rows: DataFrame, place: str) -> None:
    rows.sortWithinPartitions("term", "field", "segment").write.mode("overwrite").option("compression", "zstd").parquet(place)


def _texts(docs: DataFrame, id_col: str, fields: Sequence[str], repeated: DataFrame | None) -> DataFrame:
    """``(_id, texts of each field)`` of the rows with an id; rows of one id have all of its texts each."""
    names = [f"_text{i}" for i in range(len(fields))]
    rows = docs.select(F.col(id_col).alias("_id"), *[F.array(F.col(f)).alias(n) for f, n in zip(fields, names)]).filter("_id is not null")
    if repeated is None:
        return rows
    together = rows.join(repeated, "_id").groupBy("_id").agg(F.count(F.lit(1)).alias("_n"), *[F.flatten(F.collect_list(n)).alias(n) for n in names])
    copies = together.select("_id", *names, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_n")).drop("_n")
    return rows.join(repeated, "_id", "left_anti").unionByName(copies)


def change(
    spark: SparkSession,
    path: str,
    docs: DataFrame | None = None,
    fields: Sequence[str] = (),
    deletes: DataFrame | None = None,
    id_col: str = "_id",
    stop_words=tx.STOP_WORDS,
    merge: bool = True,
) -> int:
    """Upsert ``docs`` and delete the ids of ``deletes`` in one step; returns the new version.

    Ids are unique in ``docs``.  Readers see the new version only when all of its parts are written; one writer at a
    time.  A change that was broken off is written anew under its own name.
    """
    version = last_version(spark, path) + 1
    before = parts(spark, path)
    part = f"part-{version}"

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{part}/{name}")

    named = lambda df, n: df.select(F.col(id_col).alias("_id"), F.lit(n).cast("long").alias("n"))
    ids = spark.createDataFrame([], "_id string, n bigint") if docs is None else named(docs, 1)
    if deletes is not None:
        ids = named(deletes, 0) if docs is None else ids.unionByName(named(deletes, 0))
    write(ids.groupBy("_id").agg(F.sum("n").alias("n")), "rows")
    counted = spark.read.parquet(f"{path}/{part}/rows")
    write(counted.select("_id"), "gone")
    gone = spark.read.parquet(f"{path}/{part}/gone")
    kind = gone.schema["_id"].dataType.simpleString()
    if docs is None:
        write(spark.createDataFrame([], blocks.KIND), "postings")
        write(spark.createDataFrame([], f"_id {kind}, field string, length bigint, segment bigint, no int"), "lengths")
    else:
        # analyzed once, into the stored blocks and, in rows without a term, the lengths
        repeated = counted.filter("n > 1 and _id is not null").select("_id")
        texts = _texts(docs, id_col, fields, None if repeated.isEmpty() else repeated)
        with small_batches(spark):
            made = texts.mapInArrow(blocks.place_blocks(fields, stop_words, version << 44), f"{blocks.KIND}, ids array<{kind}>, lengths array<int>")
            _write_blocks(made, f"{path}/{part}/postings")
        segments = spark.read.parquet(f"{path}/{part}/postings").filter("term is null")
        rows = segments.select("segment", "field", F.posexplode(F.arrays_zip("ids", "lengths")).alias("no", "_doc"))
        lengths = rows.select(F.col("_doc.ids").alias("_id"), "field", F.col("_doc.lengths").cast("long").alias("length"), "segment", "no")
        # a row without an id has a length and no postings
        unnamed = counted.filter("_id is null and n > 0").select("_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_n"))
        each = F.explode(F.array(*[F.lit(f) for f in fields])).alias("field")
        none = [F.lit(v).cast(k).alias(c) for c, v, k in (("length", 0, "long"), ("segment", None, "long"), ("no", None, "int"))]
        write(lengths.unionByName(unnamed.select("_id", each, *none)), "lengths")
    _remove(spark, f"{path}/{part}/rows")
    stats, less = _field_stats(spark.read.parquet(f"{path}/{part}/lengths"), 1), spark.createDataFrame([], _FREQ)
    if before:
        names = [name for name, _ in before]
        replaced = _lengths(spark, path, names).join(gone, "_id", "left_semi")
        _write_marks(replaced, f"{path}/{part}/marks")
        less = _marked_counts(spark, path, names, f"{path}/{part}/marks")
        stats = stats.unionByName(_field_stats(replaced, -1))
    write(less, "freq")
    write(stats.groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("total").alias("total")), "stats")
    size = gone.count() + spark.read.parquet(f"{path}/{part}/lengths").count()
    after = [*before, (part, size)]
    if merge:
        after = _merged(spark, path, after, f"{part}-merged")
    _publish(spark, path, version, after)
    if (part, size) not in after:
        _remove(spark, f"{path}/{part}")  # merged at once, no version names it
    return version


def _publish(spark: SparkSession, path: str, version: int, names: Sequence[tuple[str, int]]) -> None:
    rows = spark.createDataFrame([(name, place, size) for place, (name, size) in enumerate(names)], _MANIFEST)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")


def _merged(spark: SparkSession, path: str, names: list[tuple[str, int]], new: str) -> list[tuple[str, int]]:
    """The parts after merging those that are too small for what comes after them."""
    first, total = len(names) - 1, names[-1][1]
    while first > 0 and names[first - 1][1] < TIER * total:
        first -= 1
        total += names[first][1]
    if first == len(names) - 1:
        return names
    run = [name for name, _ in names[first:]]
    _lengths(spark, path, run).write.mode("overwrite").parquet(f"{path}/{new}/lengths")
    _write_marks(_lengths(spark, path, run, live=False), f"{path}/{new}/marks")
    kept = _blocks(spark, path, run).mapInArrow(blocks.without_marked(f"{path}/{new}/marks"), blocks.KIND)
    _write_blocks(kept, f"{path}/{new}/postings")
    gone = _read(spark, path, run, "gone").select("_id").distinct()
    (gone if first else gone.limit(0)).write.mode("overwrite").parquet(f"{path}/{new}/gone")
    if first:
        # what is left out was taken away by the run itself
        taken = _read(spark, path, run, "freq").drop("_place").unionByName(_marked_counts(spark, path, run, f"{path}/{new}/marks").withColumn("df", -F.col("df")))
        freq = taken.groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df <> 0")
    else:
        freq = spark.createDataFrame([], _FREQ)
    freq.write.mode("overwrite").parquet(f"{path}/{new}/freq")
    _stats(spark, path, run).write.mode("overwrite").parquet(f"{path}/{new}/stats")
    size = sum(spark.read.parquet(f"{path}/{new}/{kind}").count() for kind in ("lengths", "gone"))
    return [*names[:first], (new, size)]


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove the parts that none of the last ``keep`` versions names, and older manifests; returns the removed parts."""
    last = last_version(spark, path)
    rows = spark.read.schema(T.StructType([T.StructField("part", T.StringType()), T.StructField("version", T.IntegerType())])).parquet(f"{path}/manifest")
    kept = F.max(F.col("version") > last - keep)
    old = [r["part"] for r in rows.groupBy("part").agg(kept.alias("kept")).filter("not kept").collect()]
    # a new part that was merged at once is in no manifest, and there only if its change was broken off
    old += [f"part-{v}" for v in range(1, last + 1) if _exists(spark, f"{path}/part-{v}-merged") and _exists(spark, f"{path}/part-{v}") and f"part-{v}" not in old]
    numbers = [r["version"] for r in rows.select("version").distinct().collect() if r["version"] <= last - keep]
    for name in [*[f"manifest/version={v}" for v in numbers], *old]:
        _remove(spark, f"{path}/{name}")
    return sorted(old)


def phrase_match(postings: DataFrame, phrase: str, field: str) -> DataFrame:
    """(_id, start, end) of every place where the phrase's words follow each other, stop words counted as places.

    Each word's places are moved back by its place in the phrase; where all words meet, the phrase begins.
    """
    words = [w for w in enumerate(tx.terms_of(phrase, stop_words=())) if w[1] not in tx.STOP_WORDS]
    if not words:
        return postings.select("_id", F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("word")) for i, w in words])
    rows = postings.filter((F.col("field") == field) & F.col("term").isin([w for _, w in words]))
    placed = rows.select("_id", "term", F.explode("places").alias("p")).select("_id", "term", "p", F.inline(at)).filter("term = word")
    meet = placed.groupBy("_id", (F.col("p.pos") - F.col("i")).alias("_begin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("p.start").alias("start"), F.max("p.end").alias("end")
    )
    return meet.filter(F.col("n") == len(words)).select("_id", "start", "end")


def snippets(postings: DataFrame, docs: DataFrame, query: str, field: str, width: int = 80, id_col: str = "_id", marks=("<em>", "</em>")) -> DataFrame:
    """The best piece of each matching text with the query's terms marked: ``(_id, snippet, start, terms)``.

    The piece holds the smallest stretch of the text that has as many different terms of the query as fit into ``width``
    characters; of equal ones the first.  Stretches come from the stored places of the terms alone: over the places in
    order, a stretch ends at each and begins at the first that is near enough, and shrinks while its first term comes again.
    Texts are read for the matching documents only, and cut at the stored offsets; the piece begins at the stretch and
    has ``width`` characters.
    """
    wanted = sorted(set(tx.terms_of(query)))
    rows = postings.filter((F.col("field") == field) & F.col("term").isin(wanted))
    flat = F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.col("term").alias("term")))))
    placed = rows.groupBy("_id").agg(F.array_sort(flat).alias("_p"))
    best = placed.mapInArrow(_covers(width), f"_id {postings.schema['_id'].dataType.simpleString()}, start bigint, terms int, spans array<struct<start:int,end:int>>")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(field).alias("_text"))
    found = best.join(texts, "_id")

    def piece(low, high):
        return F.substring(F.col("_text"), (low + 1).cast("int"), (high - low).cast("int"))

    last = F.when(F.size("spans") > 0, F.element_at("spans", -1)["end"])
    begins = F.concat(F.array(F.col("start").cast("int")), F.transform("spans", lambda s: s["end"]))
    marked = F.zip_with(
        begins, "spans", lambda low, s: F.when(s.isNotNull(), F.concat(piece(low, s["start"]), F.lit(marks[0]), piece(s["start"], s["end"]), F.lit(marks[1]))).otherwise("")
    )
    text = F.concat(F.array_join(marked, ""), piece(last, F.col("start") + width))
    return found.select(F.col("_id").alias(id_col), text.alias("snippet"), "start", "terms")


def _covers(width: int):
    """Per document the stretch with the most different terms, the shortest and first of those, and the places in its piece."""

    def best(places) -> tuple[int, int, list[dict]]:
        count: dict[str, int] = {}
        low, top = 0, None
        for high, place in enumerate(places):
            count[place["term"]] = count.get(place["term"], 0) + 1
            while low < high and (place["end"] - places[low]["start"] > width or count[places[low]["term"]] > 1):
                first = places[low]["term"]
                count[first] -= 1
                if not count[first]:
                    del count[first]
                low += 1
            found = (-len(count), place["end"] - places[low]["start"], places[low]["start"])
            if top is None or found < top:
                top = found
        start = top[2]
        inside = [{"start": p["start"], "end": p["end"]} for p in places if p["start"] >= start and p["end"] <= start + width]
        # a single term longer than the piece is marked all the same
        return start, -top[0], inside or [{"start": p["start"], "end": p["end"]} for p in places if p["start"] == start]

    def run(batches):
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                rows = batch.slice(at, TEXTS_AT_ONCE)
                found = [best(places) for places in rows.column("_p").to_pylist()]
                columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int32(), spans))]
                yield pa.RecordBatch.from_arrays([rows.column("_id"), *columns], names=["_id", "start", "terms", "spans"])

    return run
