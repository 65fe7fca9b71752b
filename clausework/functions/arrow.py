"""Arrow batches in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

ROWS_OF_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is executed inside hands Python workers at most ``rows`` rows at a time, or fewer where the session says so."""
    before = spark.conf.get(ROWS_OF_BATCH)
    spark.conf.set(ROWS_OF_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(ROWS_OF_BATCH, before)


def part_bounds(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows that hold at most ``most`` together; a larger row is a run by itself."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop - start
        start = stop


def bounded_slices(batch: pa.RecordBatch, lists: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``lists`` hold at most ``most`` values together, without a copy. Null lists count as empty."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(lists)), 0).to_numpy().astype(np.int64)
    return (batch.slice(at, n) for at, n in part_bounds(sizes, most))


def text_slices(column: pa.Array, most: int) -> Iterator[pa.Array]:
    """Slices of a column of texts of at most ``most`` bytes together. Columns of other types are cut by rows."""
    texts = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64) if texts else np.full(len(column), max(1, most // 1000))
    return (column.slice(at, n) for at, n in part_bounds(sizes, most))


def python_values(column: pa.Array) -> list:
    """``column.to_pylist()``, by way of numpy where that gives the same: whole numbers, floats, booleans and lists of them, without nulls."""
    kind = column.type
    if column.null_count == 0 and (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    if column.null_count == 0 and pa.types.is_list(kind):
        flat, ends = python_values(column.flatten()), np.cumsum(pc.list_value_length(column).to_numpy()).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]
    return column.to_pylist()
