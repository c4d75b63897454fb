"""Pages to items and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import html, urls
from corpusloom.functions.binding import let


def extract_items(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """One item row per page; the page is cleaned once for all four values."""
    made = pages.select(F.col(url), html.item(F.col(body)).alias("_item"))
    return made.select(F.col(url).alias("url"), "_item.*")


def page_links(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """Distinct absolute links of each page: ``(url, link)`` plus an ``origin`` if the page has one.

    A page's links are made distinct inside its own row, so no shuffle is needed.
    """
    kept = [c for c in ("origin",) if c in pages.columns]
    hrefs = html.html_hrefs(F.col(body))
    absolute = let(
        urls.parts(F.col(url)), lambda base: F.transform(hrefs, lambda href: urls.resolve_parts(base, href))
    )
    found = pages.select(url, *kept, F.array_distinct(absolute).alias("_links"))
    # a plain explode would have the optimizer ask below any shuffle whether there are links, which finds them all twice
    rows = found.select(F.col(url).alias("url"), *kept, F.posexplode_outer("_links").alias("_at", "link"))
    return rows.filter("_at is not null").drop("_at")


def same_site_links(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """Links that start with the page's origin, or with the inherited ``origin`` where present."""
    links = page_links(pages, url, body)
    own = urls.url_origin(F.col("url"))
    start = F.coalesce(F.col("origin"), own) if "origin" in links.columns else own
    return links.filter(F.startswith(F.col("link"), start)).select("url", "link", own.alias("next_origin"))


def translate_terms(df: DataFrame, field: str, dictionary: DataFrame, separator: str = " ") -> DataFrame:
    """Words of a field with their place, replaced by the dictionary's ``(source, target)`` where it has them."""
    words = df.select("*", F.posexplode(F.split(F.col(field), separator)).alias("pos", "_word"))
    known = dictionary.select(F.col("source"), F.col("target"))
    joined = words.join(known, F.lower("_word") == F.col("source"), "left")
    return joined.select(*df.columns, "pos", F.coalesce("target", "_word").alias("word"))
