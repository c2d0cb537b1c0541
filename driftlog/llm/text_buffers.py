"""Arrow text columns as flat byte buffers, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20


def filled(column: pa.Array) -> pa.Array:
    """The column with nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows together, and the bounds of each row in them (rows + 1 numbers)."""
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    bounds = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    bounds = bounds.astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and len(buffers[2]) else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, text_at: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with at most ``limit`` bytes of text, or a single row. No row is cut."""
    if not batch.num_rows:
        return
    _, bounds = flat(filled(batch.column(text_at)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def per_row_counts(positions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the sorted positions fall in each row."""
    return np.diff(np.searchsorted(positions, bounds))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``, ``counts[i]`` long each; empty runs give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def unit_hash(column: Column, salt: int = 0) -> Column:
    """A number from 0 to 1 by the hash of a value, in steps of 2 ** -53: for samples of any fraction."""
    return F.xxhash64(column, F.lit(salt)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
