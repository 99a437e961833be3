"""Helpers for functions over Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lodestone.session import let_workers_import

#: Bytes of column data handled at once; one longer row is handled alone.
SLICE_BYTES = 4 << 20
#: What Spark sends a worker at once; its own bound of 64 MB fills several buffers of that size in each task.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def release_memory() -> None:
    """Gives free memory back to the system; Spark keeps a Python worker for later tasks, beside other stages' needs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut into slices of about `most` bytes, so that long texts don't add up in memory."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, min(rows, rows * most // max(1, batch.nbytes)))
        for i in range(0, rows, step):
            yield batch.slice(i, step)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each value; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """mapInArrow, in small batches, by workers that find this library where the driver does; elsewhere ship it with --py-files."""
    df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    let_workers_import(df.sparkSession)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def _typed(values, kind: pa.DataType) -> pa.Array:
    if not isinstance(values, pa.Array):
        return pa.array(values, kind)
    return values if values.type == kind else values.cast(kind)


def map_slices(df: DataFrame, function: Callable[[pa.RecordBatch], dict | Iterator[dict]], schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow: function turns each slice into a dict of columns (lists or arrays), or yields several."""
    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for part in slices(batches, most):
            made = function(part)
            for columns in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays([_typed(columns[f.name], f.type) for f in fields], schema=fields)

    return map_arrow(df, run, schema)


