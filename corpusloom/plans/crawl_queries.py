"""Ledger, merge, site and crawl queries, and the file round trips."""

from __future__ import annotations

import io
import tarfile

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import urls
from corpusloom.operators import crawl, merge, sites
from corpusloom.plans.page_queries import SQL_LINKS, SQL_SITE, SQL_TEXT, SQL_TITLE, pages, sql_fingerprint
from corpusloom.plans.registry import query, quoted, table
from corpusloom.session import work_path
from corpusloom.sources import archives, files, tables

LINES_PER_ARCHIVE = 1000  # lines that a packing task holds as Python values

# Sites are first seen in the order of their lowest page; half of the pages by time are known already.
_FP = sql_fingerprint("url")


def fingerprints(spark, sf):
    return pages(spark, sf).select("page_id", "url", urls.url_fingerprint(F.col("url")).alias("fingerprint"))


def visited(spark, sf):
    """One row per page: last visit is 2024-01-01 plus one hour per page number."""
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col("page_id") * 3600)
    return fingerprints(spark, sf).groupBy("fingerprint").agg(F.max(at).alias("last_time"))


_VISITED = f"(SELECT {_FP} AS fingerprint, max(TIMESTAMP '2024-01-01' + to_hours(page_id)) AS last_time FROM pages GROUP BY 1)"


@query(
    "site_codes",
    f"""WITH s AS (SELECT {SQL_SITE} AS site, min(page_id) AS seen FROM pages GROUP BY 1)
    SELECT site, row_number() OVER (ORDER BY seen, site) AS site_code FROM s""",
)
def site_codes(spark, sf):
    seen = sites.with_site(pages(spark, sf)).select("site", F.col("page_id").alias("first_seen"))
    return sites.assign_site_codes(seen)


_HOST = "regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1)"


@query(
    "host_codes_added",
    f"""WITH dim AS (SELECT site, row_number() OVER (ORDER BY seen, site) AS site_code FROM (
        SELECT {_HOST} AS site, min(page_id) AS seen FROM pages WHERE url LIKE 'https:%' GROUP BY 1)),
    new AS (SELECT {_HOST} AS site, min(page_id) AS seen FROM pages GROUP BY 1)
    SELECT site, site_code FROM dim UNION ALL
    SELECT site, (SELECT max(site_code) FROM dim) + row_number() OVER (ORDER BY seen, site) FROM new
    WHERE site NOT IN (SELECT site FROM dim)""",
)
def host_codes_added(spark, sf):
    """Codes for the hosts of secure pages first; the other hosts follow them."""
    hosts = pages(spark, sf).select(urls.host(F.col("url")).alias("site"), F.col("page_id").alias("first_seen"), "url")
    known = sites.assign_site_codes(hosts.filter(F.col("url").startswith("https:")))
    return sites.assign_site_codes(hosts, known)


@query(
    "site_enriched",
    f"""WITH s AS (SELECT site, row_number() OVER (ORDER BY seen, site) AS site_code FROM (
      SELECT {SQL_SITE} AS site, min(page_id) AS seen FROM pages GROUP BY 1))
    SELECT page_id, site_code FROM pages JOIN s ON s.site = {SQL_SITE}""",
)
def site_enriched(spark, sf):
    docs = sites.with_site(pages(spark, sf).select("page_id", "url"))
    dim = sites.assign_site_codes(docs.withColumnRenamed("page_id", "first_seen"))
    return sites.enrich(docs, dim).select("page_id", "site_code")


@query(
    "unseen_pages",
    f"""WITH r AS (SELECT page_id, {_FP} AS fingerprint FROM pages
        UNION ALL SELECT page_id + 1000000, {_FP} FROM pages),
    seen AS (SELECT fingerprint FROM {_VISITED} WHERE last_time < TIMESTAMP '2024-01-04')
    SELECT fingerprint, min(page_id) AS page_id FROM r WHERE fingerprint NOT IN (SELECT fingerprint FROM seen) GROUP BY fingerprint""",
)
def unseen_pages(spark, sf):
    """Every page is asked for twice; those of the first days are in the seen-set."""
    asked = fingerprints(spark, sf).select("page_id", "fingerprint")
    again = asked.withColumn("page_id", F.col("page_id") + 1000000)
    seen = visited(spark, sf).filter(F.col("last_time") < F.lit("2024-01-04").cast("timestamp"))
    return crawl.filter_unseen(asked.unionByName(again), seen, seq="page_id").select("fingerprint", "page_id")


@query(
    "visited_upsert",
    f"""SELECT fingerprint, max(last_time) AS last_time FROM (SELECT * FROM {_VISITED} UNION ALL
      SELECT {_FP}, TIMESTAMP '2024-02-01' FROM pages WHERE url LIKE 'https:%' UNION ALL
      SELECT sha1(link), TIMESTAMP '2024-02-01' FROM {SQL_LINKS}) GROUP BY fingerprint""",
)
def visited_upsert(spark, sf):
    from corpusloom.operators.extract import same_site_links

    secure = fingerprints(spark, sf).filter(F.col("url").startswith("https:")).select("fingerprint")
    links = same_site_links(pages(spark, sf)).select(F.sha1("link").alias("fingerprint"))
    now = F.lit("2024-02-01").cast("timestamp")
    return merge.upsert_visited(visited(spark, sf), secure.unionByName(links), now)


@query(
    "expire_seen",
    f"""SELECT DISTINCT {_FP} AS fingerprint FROM pages WHERE {_FP} NOT IN (
      SELECT fingerprint FROM {_VISITED} WHERE last_time < TIMESTAMP '2024-02-04' - INTERVAL 30 DAYS)""",
)
def expire_seen(spark, sf):
    seen = fingerprints(spark, sf).select("fingerprint").distinct()
    return crawl.expire_seen(seen, visited(spark, sf), F.lit("2024-02-04").cast("timestamp"))


@query(
    "upsert_by_made_id",
    """WITH a AS (SELECT md5(lang || ':' || source) AS _id, doc_id, n_chars FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
    SELECT _id, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM a GROUP BY _id""",
)
def upsert_by_made_id(spark, sf):
    """Documents upserted under an id that a function of the row gives: the last of each language and source stays."""
    docs = table(spark, sf, "documents").filter("lang is not null and source is not null")
    made = docs.select(F.md5(F.concat_ws(":", "lang", "source")).alias("_id"), "doc_id", "n_chars", F.col("doc_id").alias("seq"))
    early = made.filter("doc_id % 2 = 0")
    base = merge.upsert(early.drop("seq").filter(F.lit(False)), early, ["_id"], "seq")
    return merge.upsert(base, made, ["_id"], "seq")


@query(
    "upsert_last_write",
    """WITH base AS (SELECT user_id, 'none' AS event_type, CAST(0 AS DOUBLE) AS value, -1 AS seq FROM events
        UNION ALL SELECT user_id + 100, 'old', 1, -1 FROM events),
    a AS (SELECT DISTINCT * FROM base UNION ALL SELECT user_id, event_type, value, event_id FROM events)
    SELECT user_id, arg_max(event_type, seq) AS event_type, arg_max(value, seq) AS value FROM a
    WHERE NOT (event_type = 'none' AND user_id >= 100) GROUP BY user_id""",
)
def upsert_last_write(spark, sf):
    """The last event of each user replaces the user's row; other rows stay."""
    events = table(spark, sf, "events")
    users = events.select("user_id").distinct()
    base = users.filter("user_id < 100").select("user_id", F.lit("none").alias("event_type"), F.lit(0.0).alias("value"))
    base = base.unionByName(
        users.select((F.col("user_id") + 100).alias("user_id"), F.lit("old").alias("event_type"), F.lit(1.0).alias("value"))
    )
    changes = events.select("user_id", "event_type", "value", F.col("event_id").alias("seq"))
    return merge.upsert(base, changes, ["user_id"], "seq")


@query(
    "partial_update",
    """WITH f AS (SELECT o_custkey, arg_max(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, o_orderkey) AS seg,
      arg_max(CASE WHEN o_totalprice > 300000 THEN o_totalprice END, o_orderkey) AS bal FROM orders GROUP BY o_custkey)
    SELECT c_custkey, coalesce(seg, c_mktsegment) AS c_mktsegment, coalesce(bal, c_acctbal) AS c_acctbal
    FROM customer LEFT JOIN f ON o_custkey = c_custkey""",
)
def partial_update(spark, sf):
    """Customer rows take segment and balance from their orders where an order gives one."""
    changes = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("c_mktsegment"),
        F.when(F.col("o_totalprice") > 300000, F.col("o_totalprice")).alias("c_acctbal"),
        F.col("o_orderkey").alias("seq"),
    )
    base = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return merge.partial_update(base, changes, ["c_custkey"], "seq")


@query(
    "absent_ids",
    "SELECT DISTINCT doc_id + 7 AS doc_id FROM documents WHERE doc_id + 7 NOT IN (SELECT doc_id FROM labels)",
)
def absent_ids(spark, sf):
    changes = table(spark, sf, "documents").select((F.col("doc_id") + 7).alias("doc_id"))
    return merge.absent_keys(table(spark, sf, "labels"), changes, ["doc_id"])


@query(
    "insert_absent",
    """SELECT doc_id, quality, toxic FROM labels UNION ALL
    SELECT doc_id, CAST(n_chars % 2 AS INTEGER), CAST(9 AS INTEGER) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def insert_absent(spark, sf):
    changes = table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"), F.lit(9).alias("toxic"), F.lit(1).alias("seq")
    )
    return merge.insert_absent(table(spark, sf, "labels"), changes, ["doc_id"], "seq")


@query(
    "update_present",
    """SELECT doc_id, coalesce(d.q, l.quality) AS quality, coalesce(d.t, l.toxic) AS toxic FROM labels l LEFT JOIN (
      SELECT doc_id, CAST(n_chars % 2 AS INTEGER) AS q, CAST(9 AS INTEGER) AS t FROM documents WHERE lang = 'en') d USING (doc_id)""",
)
def update_present(spark, sf):
    changes = table(spark, sf, "documents").filter("lang = 'en'").select(
        "doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"), F.lit(9).alias("toxic"), F.lit(1).alias("seq")
    )
    return merge.update_present(table(spark, sf, "labels"), changes, ["doc_id"], "seq")


@query("delete_ids", "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def delete_ids(spark, sf):
    gone = table(spark, sf, "documents").filter("lang = 'fr'")
    return merge.delete_keys(table(spark, sf, "labels"), gone, ["doc_id"]).select("doc_id", "quality")


def frontier(spark, sf):
    return fingerprints(spark, sf).select(
        "url", "fingerprint", F.length("url").alias("priority"), F.col("page_id").alias("seq")
    )


@query(
    "next_batch",
    f"SELECT url, {_FP} AS fingerprint, CAST(length(url) AS INTEGER) AS priority, page_id AS seq FROM pages ORDER BY length(url) DESC, page_id LIMIT 200",
)
def next_batch(spark, sf):
    return crawl.next_batch(frontier(spark, sf), 200)


@query(
    "next_batch_random",
    f"SELECT url, page_id AS seq FROM pages ORDER BY md5({_FP} || '#7'), {_FP} LIMIT 200",
)
def next_batch_random(spark, sf):
    return crawl.next_batch(frontier(spark, sf), 200, "random", seed=7).select("url", "seq")


@query(
    "crawl_rounds",
    f"""WITH p AS (SELECT {_FP} AS fingerprint, min(url) AS url FROM pages GROUP BY 1),
    t AS (SELECT DISTINCT {sql_fingerprint('link')} AS fingerprint FROM {SQL_LINKS} JOIN p USING (url))
    SELECT fingerprint, CAST(0 AS INTEGER) AS depth FROM p UNION ALL
    SELECT fingerprint, 1 FROM t WHERE fingerprint NOT IN (SELECT fingerprint FROM p)""",
)
def crawl_rounds(spark, sf):
    """From all pages until nothing new: the seen-set with the depth of first sight."""
    _, seen = crawl.crawl(pages(spark, sf).select("url"), pages(spark, sf))
    return seen.select("fingerprint", "depth")


@query(
    "crawl_items",
    f"""WITH p AS (SELECT {_FP} AS fingerprint, min(url) AS url FROM pages GROUP BY 1)
    SELECT fingerprint, url, CAST(0 AS INTEGER) AS depth FROM p WHERE url LIKE '%//blog.%'""",
)
def crawl_items(spark, sf):
    """Items reached from the blogs' own pages."""
    blogs = pages(spark, sf).filter(F.col("url").contains("//blog."))
    items, _ = crawl.crawl(blogs.select("url"), pages(spark, sf))
    return items.select("fingerprint", "url", "depth")


_SHOP = "https://www.shop.example/c/"


@query(
    "crawl_chain",
    f"""WITH RECURSIVE links AS (
      SELECT c_custkey AS a, unnest([3 * c_custkey, 3 * c_custkey + 1, c_custkey // 2, 7 * c_custkey + c_nationkey, c_custkey - 1]) AS b FROM customer),
    r(k, depth) AS (SELECT 1::BIGINT, 0::INTEGER
      UNION SELECT b, depth + 1 FROM r JOIN links ON a = k WHERE depth < 40)
    SELECT '{_SHOP}' || k AS url, min(depth)::INTEGER AS depth, max(c_name) AS title FROM r LEFT JOIN customer ON c_custkey = k GROUP BY k""",
)
def crawl_chain(spark, sf):
    """From the first customer's page over links to other customers' pages, with links back, until nothing new is found."""
    n = F.col("c_custkey")
    targets = F.array(3 * n, 3 * n + 1, F.floor(n / 2), 7 * n + F.col("c_nationkey"), n - 1)
    links = F.array_join(F.transform(targets, lambda t: F.concat(F.lit('<a href="/c/'), t.cast("string"), F.lit('">x</a>'))), " ")
    page = F.concat(F.lit("<html><head><title>"), "c_name", F.lit("</title></head><body>"), links, F.lit("</body></html>"))
    # links and fingerprints cost far more than reading: few pieces of the table would be few long tasks
    shop = tables.spread(table(spark, sf, "customer")).select(F.concat(F.lit(_SHOP), n.cast("string")).alias("url"), page.alias("html"))
    items, seen = crawl.crawl(shop.filter(F.col("url") == _SHOP + "1").select("url"), shop)
    return seen.join(items.select("url", "title"), "url", "left").select("url", "depth", "title")


@query("seed_urls", "SELECT 'https://' || c_name || '/' AS url FROM customer WHERE c_name <> ''")
def seed_urls(spark, sf):
    sheet = table(spark, sf, "customer").select(F.concat(F.lit("https://"), "c_name", F.lit("/")).alias("site"), "c_custkey")
    return files.seed_urls(sheet, "site")


# File round trips ---------------------------------------------------------------


def _lines(spark, sf):
    """Documents as JSON lines, and a line that does not parse for every French document."""
    docs = table(spark, sf, "documents")
    good = docs.select(F.to_json(F.struct(F.col("text").alias("content"), F.col("doc_id").cast("string").alias("code"))).alias("value"))
    bad = docs.filter("lang = 'fr'").select(F.concat(F.lit('{"content": "'), F.col("doc_id")).alias("value"))
    return good, bad


JSONL_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("content", "code", "origin", "_corrupt_record")])


@query(
    "jsonl_rows",
    "SELECT CAST(doc_id AS VARCHAR) AS code, md5(text) AS digest, 'zh' AS origin FROM documents",
)
def jsonl_rows(spark, sf):
    good, bad = _lines(spark, sf)
    rows = files.parse_lines(good.unionByName(bad), "zh", JSONL_ITEM, "value")
    return files.good_rows(rows).select("code", F.md5("content").alias("digest"), "origin")


@query("jsonl_bad_lines", "SELECT '{\"content\": \"' || doc_id AS line, 'zh' AS origin FROM documents WHERE lang = 'fr'")
def jsonl_bad_lines(spark, sf):
    good, bad = _lines(spark, sf)
    return files.bad_lines(files.parse_lines(good.unionByName(bad), "zh", JSONL_ITEM, "value"))


def _pack(batches):
    """Some lines of an Arrow batch at a time become one archive with two members, one of another kind."""
    for batch in batches:
        for at in range(0, batch.num_rows, LINES_PER_ARCHIVE):
            lines = batch.column("value").slice(at, LINES_PER_ARCHIVE).to_pylist()
            out = io.BytesIO()
            with tarfile.open(fileobj=out, mode="w:gz") as archive:
                for name, body in (("a/part.jsonl", "\n".join(lines)), ("a/notes.txt", "no line")):
                    data = body.encode()
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    archive.addfile(info, io.BytesIO(data))
            yield pa.RecordBatch.from_pydict({"content": pa.array([out.getvalue()], pa.binary())})


@query(
    "archive_rows",
    "SELECT CAST(doc_id AS VARCHAR) AS code, md5(text) AS digest, 'en' AS origin FROM documents",
)
def archive_rows(spark, sf):
    """Documents packed into archives by the tasks, and read back."""
    good, bad = _lines(spark, sf)
    archives = good.unionByName(bad).mapInArrow(_pack, "content binary")
    rows = files.good_rows(files.archive_rows(archives, "en", JSONL_ITEM))
    return rows.select("code", F.md5("content").alias("digest"), "origin")


def _tgz_writer(path: str):
    """Each archive of ``_pack`` becomes a file, named by its place, so a repeated task writes the same."""

    def run(batches):
        part = TaskContext.get().partitionId()
        for number, packed in enumerate(_pack(batches)):
            system, base = archives.place(path)
            system.create_dir(base, recursive=True)
            name = f"part-{part}-{number}.jsonl.tgz"
            with system.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(packed.column("content")[0].as_py())
            yield pa.RecordBatch.from_pydict({"name": [name]})

    return run


def _archive_files(spark, sf) -> str:
    """Documents and bad lines in archive files, and a file of another kind beside them."""
    good, bad = _lines(spark, sf)
    path = work_path(spark, "archives")
    good.unionByName(bad).mapInArrow(_tgz_writer(path), "name string").write.json(f"{path}-names")
    bad.write.mode("append").text(path)
    return path


@query(
    "jsonl_archive_files",
    "SELECT CAST(doc_id AS VARCHAR) AS code, md5(text) AS digest, 'en' AS origin FROM documents",
)
def jsonl_archive_files(spark, sf):
    """Archive files read member by member."""
    rows = files.good_rows(files.read_jsonl_archives(spark, _archive_files(spark, sf), "en", JSONL_ITEM))
    return rows.select("code", F.md5("content").alias("digest"), "origin")


def _page_writer(path: str):
    def run(batches):
        system, base = archives.place(path)
        for batch in batches:
            for page_id, text in zip(batch["page_id"], batch["html"]):
                folder = f"{base}/{page_id % 16}"
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/{page_id}.{'htm' if page_id % 3 else 'html'}", compression=None) as out:
                    out.write(text.encode())
            yield batch[["page_id"]]

    return run


@query("html_tree_items", f"SELECT page_id, {SQL_TITLE} AS title, md5({SQL_TEXT}) AS content, 'zh' AS origin FROM pages WHERE html IS NOT NULL")
def html_tree_items(spark, sf):
    """Pages written as single files in folders, read back as items."""
    path = work_path(spark, "tree")
    shown = pages(spark, sf).select("page_id", "html").filter("html is not null")
    shown.mapInPandas(_page_writer(path), "page_id long").write.json(f"{path}-names")
    items = files.read_html_tree(spark, path)
    page_id = F.regexp_extract("path", r"(\d+)\.html?$", 1).cast("long").alias("page_id")
    return items.select(page_id, "title", F.md5("content").alias("content"), "origin")


@query("queue_values", "SELECT o_custkey AS value FROM orders")
def queue_values(spark, sf):
    path = work_path(spark, "queue")
    files.dump_values(table(spark, sf, "orders"), "o_custkey", path)
    return files.load_values(spark, path, "bigint")


@query(
    "question_file",
    f"SELECT translate(c_mktsegment, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', {quoted('甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄')}) || '?' AS value FROM customer UNION ALL SELECT '问?' FROM customer",
)
def question_file(spark, sf):
    """Questions of items appended to a text file twice."""
    signs = F.translate("c_mktsegment", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄")
    customers = table(spark, sf, "customer")
    path = work_path(spark, "questions")
    files.append_questions(customers.select(F.concat(signs, F.lit("?")).alias("title"), F.lit("no question").alias("description")), path)
    files.append_questions(customers.select(F.lit("none").alias("title"), F.lit("x 问? y").alias("description")), path)
    return spark.read.text(path)


def _with_suffix(spark, path: str, suffix: str) -> None:
    """Give the files that Spark wrote below a folder another ending."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-"):
            system.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name.split(".")[0] + suffix))


@query(
    "jsonl_files",
    "SELECT CAST(doc_id AS VARCHAR) AS code, md5(text) AS digest, 'zh' AS origin FROM documents",
)
def jsonl_files(spark, sf):
    """Documents written as JSON lines, with bad lines among them and a file of another kind beside them, read back."""
    good, bad = _lines(spark, sf)
    path = work_path(spark, "jsonl")
    good.unionByName(bad).write.text(path)
    _with_suffix(spark, path, ".jsonl")
    good.write.mode("append").text(path)
    return files.good_rows(files.read_jsonl(spark, path, "zh", JSONL_ITEM)).select("code", F.md5("content").alias("digest"), "origin")


@query(
    "pipe_text_files",
    """SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS priority FROM orders""",
)
def pipe_text_files(spark, sf):
    """Orders written as lines with fields between bars, a line of names at the head of each file, read back."""
    path = work_path(spark, "bars")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"))
    rows.repartition(3).write.option("header", True).option("sep", " | ").option("quote", "").csv(path)
    return files.read_pipe_text(spark, path)
