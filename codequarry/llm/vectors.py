"""Array columns of numbers as numpy matrices, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_ENTRIES = 1 << 19


def pieces(batch: pa.RecordBatch, dims: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose vectors of ``dims`` entries add up to about ``PIECE_ENTRIES``."""
    rows = max(1, PIECE_ENTRIES // max(1, dims))
    for begin in range(0, batch.num_rows, rows):
        yield batch.slice(begin, rows)


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, matrix)`` for each length of vector: the rows without null, missing or non-finite entries, as doubles.

    Null and empty vectors are in none.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for dims in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dims)
        matrix = flat[starts[rows, None] + np.arange(dims)]
        finite = np.isfinite(matrix).all(axis=1)
        yield rows[finite], matrix[finite]


def stepped(matrix: np.ndarray, scale: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """``floor(scale * x)`` as integers for the rows below ``limit`` in magnitude, and which rows those are."""
    with np.errstate(over="ignore"):
        steps = np.floor(matrix * scale)
    small = (np.abs(steps) < limit).all(axis=1)
    return steps[small].astype(np.int64), small


def unpacked(column: pa.Array, dims: int, kind: type = np.int64) -> np.ndarray:
    """A binary column of equally long vectors as one matrix."""
    values = column.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    first = int(np.frombuffer(offsets, np.int64)[values.offset]) if len(values) else 0
    held = np.frombuffer(data, np.uint8)[first:first + len(values) * dims * np.dtype(kind).itemsize] if len(values) else np.empty(0, np.uint8)
    return held.view(kind).reshape(len(values), dims)


def packed(matrix: np.ndarray) -> pa.Array:
    """Each row of ``matrix`` as the bytes of its entries."""
    return pa.array([row.tobytes() for row in matrix], pa.binary())


def exact_sums(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column sums as ``high * 2**32 + low``, neither of which overflows for up to two thousand million rows."""
    return (matrix >> 32).sum(axis=0), (matrix & 0xFFFFFFFF).sum(axis=0)
