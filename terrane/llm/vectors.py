"""Vectors of an embeddings table as blocks of numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(which rows hold a vector without null or non-finite components, those rows as doubles); of length ``dim`` if it is given,
    else of the first one's length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if not n:
        return np.zeros(0, bool), np.zeros((0, dim or 0))
    off = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    nan = values.to_numpy(zero_copy_only=False).astype(np.float64)
    good = np.isfinite(nan)
    bad = np.concatenate([[0], np.cumsum(~good)])
    size = np.diff(off)
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (bad[off[1:]] == bad[off[:-1]]) & (size > 0)
    if dim is None:
        dim = int(size[ok][0]) if ok.any() else 0
    ok &= size == dim
    at = off[:-1][ok]
    return ok, nan[at[:, None] + np.arange(dim)]
