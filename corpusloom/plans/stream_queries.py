"""Streams over the tables, run to their end; each equals its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import html, text as tx, urls
from corpusloom.plans import crawl_queries as cq
from corpusloom.plans import key_queries as kq
from corpusloom.plans import page_queries as pq
from corpusloom.plans.registry import SQL, query, table
from corpusloom.session import work_path
from corpusloom.sources import files, tables
from corpusloom.streaming import ingest, keyed, moves


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table's Parquet files as a stream."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf.rstrip('/')}/{name}.parquet*")


def run_to_files(stream: DataFrame, name: str) -> DataFrame:
    """Drain an append stream into Parquet files and read them."""
    spark = stream.sparkSession
    path = work_path(spark, name)
    job = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    job.format("parquet").start(f"{path}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def run_updates(stream: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """Drain an update stream; each batch overwrites its own folder, later batches win."""
    spark = stream.sparkSession
    path = work_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    job = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state")
    job.foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows")


def _ingested(spark: SparkSession, sf: str, rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    path = work_path(spark, "ingest")
    # a batch of few files, or of files of one row group, would be few tasks' work
    pages = stream_of(spark, sf, "pages").repartition(tables.PIECES * spark.sparkContext.defaultParallelism)
    items = pages.select("url", F.col("page_id").alias("seq"), html.item(F.col("html")).alias("_i")).select("url", "seq", "_i.*")
    job = ingest.stream_ingest(items, f"{path}/raw", f"{path}/plain", f"{path}/sites", f"{path}/state", default_url=pq.NO_URL, rules=rules)
    job.awaitTermination()
    return ingest.current(spark, f"{path}/raw"), ingest.current(spark, f"{path}/plain")


_FP = pq.sql_fingerprint("url")
_PLAIN = pq.sql_unescape(pq.sql_rules(f"({pq.SQL_TEXT})", pq._MARK_RULES))


# Of pages with one fingerprint the last one stays.
_LAST = f"(SELECT url, page_id, html FROM (SELECT *, row_number() OVER (PARTITION BY {_FP} ORDER BY page_id DESC) AS r FROM pages) WHERE r = 1)"


@query("stream_ingest_raw", f"SELECT {_FP} AS _id, md5({pq.SQL_TEXT}) AS content, {pq.SQL_TITLE} AS title, 'zh' AS origin FROM {_LAST}")
def stream_ingest_raw(spark, sf):
    raw, _ = _ingested(spark, sf)
    return raw.select("_id", F.md5("content").alias("content"), "title", "origin")


@query(
    "stream_ingest_plain",
    f"""WITH s AS (SELECT site, row_number() OVER (ORDER BY site) AS site_code FROM (SELECT DISTINCT {pq.SQL_SITE} AS site FROM pages))
    SELECT {_FP} AS _id, md5({_PLAIN}) AS content, site_code FROM {_LAST} JOIN s ON s.site = {pq.SQL_SITE}""",
)
def stream_ingest_plain(spark, sf):
    _, plain = _ingested(spark, sf)
    return plain.select("_id", F.md5("content").alias("content"), "site_code")


@query(
    "stream_ingest_by_rules",
    f"""WITH r AS ({SQL['site_by_suffix_table']}), s AS (SELECT site, row_number() OVER (ORDER BY site) AS site_code FROM (SELECT DISTINCT r.site FROM r JOIN {_LAST} l USING (page_id)))
    SELECT {_FP} AS _id, site_code FROM {_LAST} JOIN r USING (page_id) JOIN s USING (site)""",
)
def stream_ingest_by_rules(spark, sf):
    """Site codes of ingested pages by a table of public suffixes."""
    rules = spark.createDataFrame([(r,) for r in pq._SUFFIX_RULES], "suffix string")
    _, plain = _ingested(spark, sf, rules)
    return plain.select("_id", "site_code")


@query(
    "stream_items_files",
    "SELECT CAST(doc_id AS VARCHAR) AS code, md5(text) AS digest FROM documents",
)
def stream_items_files(spark, sf):
    """A folder of JSON-lines files with bad lines, read as a stream of a few files per batch."""
    good, bad = cq._lines(spark, sf)
    path = work_path(spark, "json-items")
    good.unionByName(bad).repartition(6).write.text(path)
    items = ingest.stream_items(spark, path, cq.JSONL_ITEM, files_per_batch=4)
    return run_to_files(items.select("code", F.md5("content").alias("digest")), "items")


@query(
    "stream_archive_files",
    "SELECT CAST(doc_id AS VARCHAR) AS code, md5(text) AS digest, 'en' AS origin FROM documents",
)
def stream_archive_files(spark, sf):
    """A folder of archives, read as a stream of a few archives per batch."""
    rows = files.stream_jsonl_archives(spark, cq._archive_files(spark, sf), "en", cq.JSONL_ITEM, files_per_batch=3)
    return run_to_files(files.good_rows(rows).select("code", F.md5("content").alias("digest"), "origin"), "archived")


@query("stream_dedupe", f"SELECT DISTINCT {_FP} AS fingerprint FROM pages")
def stream_dedupe(spark, sf):
    pages = stream_of(spark, sf, "pages")
    seconds = F.lit(1704067200) + F.col("page_id") * 60
    asked = pages.select(urls.url_fingerprint(F.col("url")).alias("fingerprint"), F.timestamp_seconds(seconds).alias("ts"))
    twice = asked.select(F.explode(F.array("fingerprint", "fingerprint")).alias("fingerprint"), "ts")
    return run_to_files(keyed.stream_unseen(twice), "unseen").select("fingerprint")


@query("stream_counters", "SELECT user_id, event_type, count(*) AS value FROM events GROUP BY user_id, event_type")
def stream_counters(spark, sf):
    deltas = stream_of(spark, sf, "events").select("user_id", "event_type", F.lit(1).alias("delta"))
    rows = run_updates(keyed.stream_counters(deltas, ["user_id", "event_type"]), "counters")
    last = rows.groupBy("user_id", "event_type").agg(F.max_by("value", "batch").alias("value"))
    return last.select("user_id", "event_type", "value")


_COMMANDS = """SELECT user_id AS key, event_id AS seq, ts::timestamp AS ts,
      CASE event_id % 10 WHEN 0 THEN 'expire' WHEN 1 THEN 'expire' WHEN 2 THEN 'set' WHEN 3 THEN 'persist' WHEN 4 THEN 'del' ELSE 'incr' END AS op,
      CASE WHEN event_id % 10 < 2 THEN 3600 * (1 + event_id % 37) ELSE 1 + event_id % 5 END AS amount FROM events"""


@query(
    "stream_expiring_counters",
    f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS i FROM ({_COMMANDS})),
    s(key, i, value, expire_at) AS (
      SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, NULL::TIMESTAMP FROM c
      UNION ALL
      SELECT key, i,
        CASE op WHEN 'incr' THEN coalesce(live, 0) + amount WHEN 'set' THEN amount WHEN 'del' THEN NULL ELSE live END,
        CASE op WHEN 'incr' THEN until WHEN 'expire' THEN CASE WHEN live IS NOT NULL THEN ts + to_seconds(amount) END ELSE NULL END
      FROM (SELECT c.*, CASE WHEN s.expire_at <= c.ts THEN NULL ELSE s.value END AS live, CASE WHEN s.expire_at <= c.ts THEN NULL ELSE s.expire_at END AS until
        FROM s JOIN c ON c.key = s.key AND c.i = s.i + 1))
    SELECT key::VARCHAR AS key, max_by(coalesce(value, -1), i) AS value, nullif(max_by(coalesce(expire_at, TIMESTAMP '1970-01-01'), i), TIMESTAMP '1970-01-01') AS expire_at FROM s GROUP BY key""",
)
def stream_expiring_counters(spark, sf):
    """The last state of each user's counter, -1 where it is gone."""
    events = stream_of(spark, sf, "events")
    n = F.col("event_id")
    last = n % 10
    op = F.when(last < 2, "expire").when(last == 2, "set").when(last == 3, "persist").when(last == 4, "del").otherwise("incr")
    amount = F.when(last < 2, 3600 * (1 + n % 37)).otherwise(1 + n % 5)
    commands = events.select(F.col("user_id").alias("key"), op.alias("op"), amount.alias("amount"), F.col("ts").cast("timestamp").alias("ts"), n.alias("seq"))
    with keyed.state_with_timers(spark):
        rows = run_updates(keyed.stream_expiring_counters(commands), "expiring").filter("not expired")
    newest = F.max_by(F.struct("value", "expire_at"), "batch")
    return rows.groupBy("key").agg(newest.alias("s")).select("key", F.coalesce("s.value", F.lit(-1)).alias("value"), "s.expire_at")


@query("stream_route", kq.ROUTED)
def stream_route(spark, sf):
    messages = stream_of(spark, sf, "events").select(F.col("event_type").alias("channel"), F.col("event_id").alias("payload"))
    routed = keyed.stream_route(messages, kq.subscriptions(spark, sf))
    return run_to_files(routed.select("payload", "channel", "subscriber", "pattern"), "routed")


@query(
    "stream_pop",
    """SELECT 0::INTEGER AS priority, doc_id AS seq, lang AS value FROM documents
    UNION ALL SELECT 1, item_id, 'bench' FROM benchmark""",
)
def stream_pop(spark, sf):
    """Two queues consumed in argument order."""
    path = work_path(spark, "pop")
    table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("lang").alias("value")).write.parquet(f"{path}/first")
    table(spark, sf, "benchmark").select(F.col("item_id").alias("seq"), F.lit("bench").alias("value")).write.parquet(f"{path}/second")
    schema = spark.read.parquet(f"{path}/first").schema
    queue = keyed.stream_pop(spark, [f"{path}/first", f"{path}/second"], schema, "parquet")
    keyed.pop_into(queue, f"{path}/taken", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/taken").select("priority", "seq", "value")


_MOVED = """WITH i AS (SELECT source AS list, doc_id AS value, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents WHERE source IS NOT NULL),
    q AS (SELECT 'src' || (c_custkey % 9) AS list, 'done' || (c_custkey % 9 % 4) AS dest, row_number() OVER (PARTITION BY c_custkey % 9 ORDER BY c_custkey) - 1 AS n FROM customer),
    m AS (SELECT list, dest, n, value FROM i JOIN q USING (list, n))"""


def _rotated(spark: SparkSession, sf: str) -> str:
    """Documents queue up in the list of their source, customers ask for them; two batches, requests first."""
    path = work_path(spark, "rotate")
    nine = F.col("c_custkey") % 9
    asked = table(spark, sf, "customer").select(
        F.lit("move").alias("kind"), F.concat(F.lit("src"), nine).alias("list"), F.concat(F.lit("done"), nine % 4).alias("to"),
        F.col("c_custkey").alias("seq"), F.lit(None).cast("string").alias("value"),
    )
    pushed = table(spark, sf, "documents").select(
        F.lit("push").alias("kind"), F.col("source").alias("list"), F.lit(None).cast("string").alias("to"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("value")
    )
    for part in (asked, pushed):
        part.write.mode("append").parquet(f"{path}/in")
        commands = spark.readStream.schema(asked.schema).parquet(f"{path}/in")
        moves.stream_moves(commands, f"{path}/out", f"{path}/state").awaitTermination()
    return f"{path}/out"


@query(
    "stream_rotate",
    f"""{_MOVED} SELECT dest AS list, count(*) OVER (PARTITION BY dest) - row_number() OVER (PARTITION BY dest ORDER BY list, n) AS position, value::VARCHAR AS value FROM m""",
)
def stream_rotate(spark, sf):
    """The lists that tail-to-head moves have built."""
    return moves.target_lists(spark, _rotated(spark, sf))


@query(
    "stream_rotate_waiting",
    f"""{_MOVED} SELECT list, 'push' AS kind, n, value::VARCHAR AS value FROM i ANTI JOIN m USING (list, n) UNION ALL SELECT list, 'move', n, NULL FROM q ANTI JOIN m USING (list, n)""",
)
def stream_rotate_waiting(spark, sf):
    """Items without a request and requests without an item."""
    return moves.waiting(spark, _rotated(spark, sf))
