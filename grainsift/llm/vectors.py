"""Vectors of an Arrow list column as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per vector length: positions and a matrix of doubles. Vectors that are null, empty or hold null or non-finite
    components are in none of them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column) or pa.types.is_null(column.type):
        return
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = pc.fill_null(column.values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    lengths = np.diff(offsets)
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    for size in np.unique(lengths[usable]):
        rows = np.flatnonzero(usable & (lengths == size))
        yield rows, flat[offsets[rows][:, None] + np.arange(size)]
