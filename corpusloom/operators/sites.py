"""Site dictionary: a stable integer per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.operators.ranking import with_rank


def with_site(df: DataFrame, url: str = "url", suffixes=urls.SUFFIXES) -> DataFrame:
    return df.withColumn("site", urls.registered_domain(F.col(url), suffixes))


def site_by_rules(df: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Add ``site`` from a table of public suffixes of any size: ``rules(suffix)``.

    A rule is a suffix, ``*.suffix`` (each name right below is a suffix too) or
    ``!name`` (that name is none).  The longest match counts, exceptions first;
    without a match the last label is the suffix.  Every distinct host is looked
    up once, with one row per label, by an equality join.
    """
    name = urls.host(F.col(url))
    labels = F.split("_host", r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    hosts = df.select(name.alias("_host")).filter("_host is not null").distinct()
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.struct(n.alias("n"), last(n).alias("tail")))
    mark = F.regexp_extract("suffix", r"^(\*\.|!)", 1)
    known = rules.filter("suffix is not null").select(F.lower(F.regexp_replace("suffix", r"^(\*\.|!)", "")).alias("tail"), mark.alias("mark")).distinct()
    n = F.col("n")
    size = (
        hosts.select("_host", F.inline(tails))
        .join(known, "tail")
        .groupBy("_host")
        .agg(
            F.max(F.when(F.col("mark") == "!", n - 1)).alias("except"),
            F.max(F.when(F.col("mark") == "*.", n + 1).when(F.col("mark") == "", n)).alias("match"),
        )
    )
    address = F.col("_host").rlike(r"^[0-9.]+$|^\[|:")
    found = hosts.join(size, "_host", "left").withColumn("_n", F.coalesce("except", "match", F.lit(1)) + 1)
    sites = found.select("_host", F.when(address, F.col("_host")).otherwise(last(F.col("_n"))).alias("site"))
    return df.withColumn("_host", name).join(sites, "_host", "left").drop("_host")


def assign_site_codes(
    sites: DataFrame, dim: DataFrame | None = None, seen: str = "first_seen", buckets: int | None = None
) -> DataFrame:
    """The dictionary with all sites: known codes stay, new ones follow the highest code.

    New sites are numbered by (first seen, site), so a rerun gives the same codes.
    """
    first = sites.groupBy("site").agg(F.min(seen).alias("_seen"))
    start: Column = F.lit(0)
    if dim is not None:
        first = first.join(dim.select("site"), "site", "left_anti")
        start = dim.agg(F.coalesce(F.max("site_code"), F.lit(0))).scalar()
    ranked = with_rank(first, [], ["_seen", "site"], "_rank", "_size", buckets)
    new = ranked.select("site", (start + F.col("_rank") + 1).cast("long").alias("site_code"))
    return new if dim is None else dim.select("site", "site_code").unionByName(new)


def enrich(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Add ``site_code`` by site; the optimizer picks the join from the size of the dictionary."""
    return df.join(dim.select("site", "site_code"), "site", "left")
