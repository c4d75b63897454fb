"""Schemas of the tables that pass between the stages."""

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


TEXT_FIELDS = ("title", "keywords", "description", "content")

ITEM = T.StructType(_strings("url", "title", "description", "keywords", "content"))

# One ingest line: an item, optionally with a code and an origin; a line that
# does not parse is kept whole in the last column.
INGEST = T.StructType([*ITEM.fields, *_strings("code", "origin", "_corrupt_record")])

DOC_RAW = T.StructType(_strings("_id", "url", "title", "keywords", "description", "content", "origin"))
DOC_PLAIN = T.StructType([*DOC_RAW.fields, T.StructField("site_code", T.LongType())])

VISITED = T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("last_time", T.TimestampType())])
SITE = T.StructType([T.StructField("site", T.StringType()), T.StructField("site_code", T.LongType())])
