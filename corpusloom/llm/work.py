"""Stored intermediate tables and runs of equal keys in Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import BATCH_ROWS, small_batches, work_path


def give_back() -> None:
    """What Arrow and the C library hold without use goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which its worker is small: it waits beside later stages that need the memory."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return rows


def store(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back, so that no later stage depends on an executor."""
    spark = df.sparkSession
    path = work_path(spark, name)
    with small_batches(spark, batch_rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def with_columns_of(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Only the named columns, an absent one as null; columns of other names never clash with a result's."""
    return df.select(*[F.col(name) if name in df.columns else F.lit(None).alias(name) for name in wanted])


def runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """One table per run of equal non-null integer keys; the batches must be sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges[:-1], edges[1:]):
            key = tuple(c[low] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = key
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def binary_views(column: pa.ChunkedArray, dtype: type) -> list[np.ndarray]:
    """Each value of a binary column as a numpy array."""
    return [np.frombuffer(v, dtype) for v in column.to_pylist()]
