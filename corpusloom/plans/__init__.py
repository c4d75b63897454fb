"""Named queries over the tables of a data folder, each with its SQL twin."""

from corpusloom.plans import crawl_queries, key_queries, page_queries, search_queries, set_queries, stream_queries  # noqa: F401
from corpusloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
