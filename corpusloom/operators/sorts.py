"""Sort of list, set or sorted-set items, with weights and values from other tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ranking import with_rank


def sort_by(
    items: DataFrame,
    by: DataFrame | None = None,
    get: Mapping[str, DataFrame] | None = None,
    alpha: bool = False,
    desc: bool = False,
    offset: int = 0,
    count: int | None = None,
    no_sort: bool = False,
    item: str = "item",
) -> DataFrame:
    """Items by their own value, or by the weight that ``by(item, weight)`` gives them.

    ``get`` maps a result column to a table ``(item, value)``; absent values are
    null.  Numeric sorts count a missing weight as 0 and break ties by the
    item's text; text sorts put a missing weight first.  ``no_sort`` keeps the
    items as they are and reads no weights.  With ``count`` the sort is a top-k,
    and ``get`` is looked up for those rows only.
    """
    order = None if no_sort else _order(items, by, alpha, desc, item)
    rows = items
    if order is not None:
        rows, columns = order
        if offset and (count is None or count < 0):
            # all rows behind the offset: cut by rank, as an offset alone would take every row through one place
            rows = with_rank(rows, [], columns, "_pos", "_all").filter(F.col("_pos") >= offset).drop("_pos", "_all")
            offset = 0
        rows = rows.orderBy(*columns)
    if offset:
        rows = rows.offset(offset)
    if count is not None and count >= 0:
        rows = rows.limit(count)
    if get:
        names = [c for c in rows.columns]
        for name, table in get.items():
            rows = rows.join(table.select(F.col(item), F.col("value").alias(name)), item, "left")
        rows = rows.select(*names, *get)
        if order is not None:
            rows = rows.orderBy(*order[1])
    return rows.drop("_weight")


def _order(items: DataFrame, by: DataFrame | None, alpha: bool, desc: bool, item: str) -> tuple[DataFrame, list[Column]]:
    if by is None:
        rows, weight = items, F.col(item)
    else:
        rows = items.join(by.select(F.col(item), F.col("weight").alias("_w")), item, "left")
        weight = F.col("_w")
    if alpha:
        rows = rows.withColumn("_weight", weight.cast("string"))
    else:
        # a weight that is no number is an error, as ANSI casts make it
        rows = rows.withColumn("_weight", F.coalesce(weight.cast("double"), F.lit(0.0)))
    rows = rows.drop("_w")
    text = F.col(item).cast("string")
    if desc:
        return rows, [F.col("_weight").desc_nulls_last(), text.desc()]
    return rows, [F.col("_weight").asc_nulls_first(), text.asc()]
