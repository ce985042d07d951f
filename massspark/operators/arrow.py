"""Arrow batches inside tasks: bounded in bytes, text as bytes, the worker's free memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Text bytes that one NumPy pass works on; a longer text is a pass of its own.
PASS_BYTES = 2 << 20

#: Bytes of an Arrow batch between the JVM and a Python worker, where the session sets no bound of its own.
BATCH_BYTES = 4 << 20
_BATCH_SETTING, _UNBOUNDED = "spark.sql.execution.arrow.maxBytesPerBatch", 2**31 - 1


def _tidied(run: Callable) -> Callable:
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:  # workers are used again by other stages, so what a task has freed goes back to the system
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with batches bounded in bytes and the worker's free memory given back after each task."""
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH_SETTING, str(_UNBOUNDED))) >= _UNBOUNDED:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(_tidied(run), schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the column holds at most `most` bytes, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and where each row starts (one more for the end). Null is empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, so many of each."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The strings of so many bytes from each start."""
    edges = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    flat = np.ascontiguousarray(data[runs(starts, sizes)])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(edges), pa.py_buffer(flat)).cast(pa.string())
