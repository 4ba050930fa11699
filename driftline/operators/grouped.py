"""Many series in one pass of a task: kernels get the columns of one series after another, without a group's own exchange."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.native import dealt

#: Rows of results that are handed on at once.
ROWS = 20_000


def _series(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each series, which lie one after another; a series may go over several batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        runs = pc.run_end_encode(batch.column("series_id"))
        start = 0
        for end in runs.run_ends.to_pylist():
            part = batch.slice(start, end - start)
            if held and held[-1].column("series_id")[0] != part.column("series_id")[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
            start = end
    if held:
        yield pa.Table.from_batches(held)


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """A column of numbers, or of arrays of them as rows, with NaN for null."""
    if pa.types.is_list(column.type):
        return np.array(column.to_pylist(), dtype=np.float64)
    return column.to_numpy().astype(np.float64)


def _several(tables: Iterator[pa.Table], most: int) -> Iterator[list[pa.Table]]:
    """Series one after another as lists of some, of as many rows in all; a series that is longer is alone or the last one."""
    held, rows = [], 0
    for table in tables:
        held.append(table)
        rows += table.num_rows
        if rows >= most:
            yield held
            held, rows = [], 0
    if held:
        yield held


def by_series(s: DataFrame, order: str, kernel: Callable, schema: str, together: int = 0) -> DataFrame:
    """The kernel's rows for each series of s, whose rows it gets in the given order. Rows without series_id are one series.

    together: the kernel takes lists of series instead of one, up to the one that makes so many rows.
    """
    columns = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for given in _several(_series(batches), together) if together else _series(batches):
            out += kernel(given)
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=columns)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=columns)

    return dealt(s).sortWithinPartitions("series_id", order).mapInArrow(run, schema)
