"""Crawl-to-search analytics expressed as Spark DataFrame programs."""
