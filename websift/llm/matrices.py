"""Vectors in Arrow columns as matrices of exact integers, for the operators that compare vectors in integers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest long; sums that do not fit are held at it.
LARGEST = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether a vector is not null and holds neither nulls nor non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of doubles) for each length of the vectors of a column; rows with null or non-finite components are left out."""
    offsets = np.asarray(column.offsets, np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    lengths, valid = np.diff(offsets), column.is_valid().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[valid]):
        rows = np.flatnonzero(valid & (lengths == n))
        m = values[offsets[rows][:, None] + np.arange(n)]
        good = np.isfinite(m).all(1)
        if good.any():
            yield rows[good], m[good]


def floors(m: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly, for a power of two as scale: 64-bit integers, or Python's where some are far too large."""
    if largest(m) < 1 << 40:
        return np.floor(m * scale).astype(np.int64)
    out = np.empty(m.shape, object)
    out.ravel()[:] = [math.floor(x * scale) if abs(x) < 1 << 53 else int(x) * scale for x in m.ravel().tolist()]
    return out


def largest(m: np.ndarray):
    return np.abs(m).max() if m.size else 0


def clamped(sums: np.ndarray) -> np.ndarray:
    return np.array([max(-LARGEST, min(LARGEST, int(x))) for x in sums.tolist()], np.int64) if sums.dtype == object else sums.astype(np.int64)
