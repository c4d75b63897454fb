"""Crawl steps over a given table of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import html, urls
from corpusloom.operators import bloom
from corpusloom.operators.extract import same_site_links
from corpusloom.session import checkpoint_root

FOLD = 4  # rounds between two foldings of the seen-set


def filter_unseen(requests: DataFrame, seen: DataFrame | None = None, fp: str = "fingerprint", seq: str | None = None) -> DataFrame:
    """The first request of each fingerprint that is not in the seen-set.

    ``seq`` names the arrival order.  Without it any one request of a fingerprint stays.
    """
    # Folded first: copies of one request end in the map tasks and never meet the seen-set.
    if seq is None:
        first = requests.dropDuplicates([fp])
    else:
        row = F.struct(*requests.columns)
        first = requests.groupBy(fp).agg(F.min_by(row, F.col(seq)).alias("_row")).select("_row.*")
    return first if seen is None else first.join(seen.select(fp), fp, "left_anti")


def next_batch(frontier: DataFrame, n: int = 200, mode: str = "priority", seq: str = "seq", seed: int = 0) -> DataFrame:
    """The next ``n`` requests: by priority, or in a seeded random order."""
    if mode == "priority":
        return frontier.orderBy(F.col("priority").desc(), F.col(seq)).limit(n)
    if mode == "random":
        return frontier.orderBy(random_order(F.col("fingerprint"), seed), "fingerprint").limit(n)
    raise ValueError(f"mode must be priority or random, not {mode!r}")


def random_order(value: Column, seed: int) -> Column:
    """A fixed pseudo-random sort key: the same on every run and in every engine."""
    return F.md5(F.concat(value.cast("string"), F.lit(f"#{seed}")))


def rest_of(frontier: DataFrame, batch: DataFrame, fp: str = "fingerprint") -> DataFrame:
    return frontier.join(batch.select(fp), fp, "left_anti")


def expire_seen(seen: DataFrame, visited: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """The seen-set without fingerprints last visited more than ``days`` ago."""
    old = visited.filter(F.col("last_time") < now - F.expr(f"INTERVAL {days} DAYS"))
    return seen.join(old.select("fingerprint"), "fingerprint", "left_anti")


def page_graph(pages: DataFrame, domains: str = "") -> DataFrame:
    """Same-site links between fingerprints: ``(fingerprint, target, target_url)``.

    The pages are read once for their links; rounds then work on this narrow
    table.  Of several pages with one fingerprint, that of the lowest url counts.
    """
    links = same_site_links(pages).filter(urls.allowed_host(F.col("link"), domains))
    edges = links.select(
        urls.url_fingerprint(F.col("url")).alias("fingerprint"),
        "url",
        urls.url_fingerprint(F.col("link")).alias("target"),
        F.col("link").alias("target_url"),
    )
    chosen = pages.select(urls.url_fingerprint(F.col("url")).alias("fingerprint"), "url")
    chosen = chosen.groupBy("fingerprint").agg(F.min("url").alias("url"))
    return edges.join(chosen, ["fingerprint", "url"], "left_semi").select("fingerprint", "target", "target_url")


def crawl_round(
    frontier: DataFrame, graph: DataFrame, seen: DataFrame, seen_filter: DataFrame | None = None, blocks: int = 0
) -> DataFrame:
    """The next frontier ``(fingerprint, url)``: targets of the frontier's links that are not seen.

    With a Bloom filter of the seen fingerprints (``bloom.bloom`` with ``blocks``) only targets that pass it are looked
    up in the seen-set.
    """
    reached = graph.join(frontier.select("fingerprint"), "fingerprint", "left_semi")
    targets = reached.groupBy(F.col("target").alias("fingerprint")).agg(F.min("target_url").alias("url"))
    if seen_filter is not None:
        return bloom.without_known(targets, seen, "fingerprint", seen_filter, blocks)
    return targets.join(seen.select("fingerprint"), "fingerprint", "left_anti")


def seen_items(seen: DataFrame, pages: DataFrame) -> DataFrame:
    """Items of every seen page that the table holds, one per fingerprint, with its depth.

    Which page stands for a fingerprint is found on narrow rows; only the chosen pages' texts are read.
    """
    read = pages.select(urls.url_fingerprint(F.col("url")).alias("fingerprint"), "url")
    chosen = read.join(seen.select("fingerprint", "depth"), "fingerprint").groupBy("fingerprint", "depth").agg(F.min("url").alias("url"))
    # texts that nobody asks for are left out before any of them moves; of several texts of one url the lowest counts
    asked = pages.select("url", "html").join(chosen.select("url"), "url", "left_semi")
    texts = asked.groupBy("url").agg(F.min("html").alias("html"))
    made = texts.join(chosen, "url").select("fingerprint", "depth", "url", html.item(F.col("html")).alias("_item"))
    return made.select("fingerprint", "depth", "url", "_item.*")


def crawl(
    seeds: DataFrame, pages: DataFrame, max_rounds: int | None = None, domains: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Follow same-site links from ``seeds`` until nothing new is found.

    ``seeds`` has ``url`` and ``pages`` has ``(url, html)``.  Returns the items
    with their depth, and the seen-set with the depth of first sight.  The link
    graph and each round's frontier are checkpointed, and every ``FOLD`` rounds
    the seen-set becomes one checkpointed table partitioned by fingerprint and
    its filter is checkpointed, so neither lineage nor plan grows with the
    number of rounds; only a frontier's emptiness is asked on the driver.  A
    Bloom filter of the seen fingerprints, sized by the graph's targets and
    merged round by round, keeps new targets away from the seen-set.
    """
    checkpoint_root(seeds.sparkSession)
    graph = page_graph(pages, domains).checkpoint()
    first = seeds.filter(urls.allowed_host(F.col("url"), domains)).select(
        "url", urls.url_fingerprint(F.col("url")).alias("fingerprint")
    )
    frontier = first.groupBy("fingerprint").agg(F.min("url").alias("url")).checkpoint()
    seen = frontier.select("fingerprint", "url", F.lit(0).alias("depth"))
    targets = graph.agg(F.approx_count_distinct("target")).first()[0]
    blocks = bloom.blocks_for(targets + frontier.count())
    known = bloom.bloom(frontier, "fingerprint", blocks).checkpoint()
    depth = 0
    while not frontier.isEmpty() and (max_rounds is None or depth < max_rounds):
        depth += 1
        frontier = crawl_round(frontier, graph, seen, known, blocks).checkpoint()
        known = bloom.merged(known, bloom.bloom(frontier, "fingerprint", blocks))
        seen = seen.unionByName(frontier.select("fingerprint", "url", F.lit(depth).alias("depth")))
        if depth % FOLD == 0:
            seen = seen.repartition("fingerprint").checkpoint()
            known = known.checkpoint()
    return seen_items(seen, pages), seen
