"""Vectors between Arrow batches and numpy without a Python object per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal-length vectors as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def list_column(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    n, width = rows.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)
    return pa.ListArray.from_arrays(offsets, np.ascontiguousarray(rows, dtype=np.float64).ravel())


def batch(**columns) -> pa.RecordBatch:
    """Columns given as numpy arrays, matrices or Arrow arrays."""
    arrays = [
        c if isinstance(c, pa.Array) else list_column(c) if np.ndim(c) == 2 else pa.array(c)
        for c in columns.values()
    ]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Batches behind each other as one that holds some rows."""
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
