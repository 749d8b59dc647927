"""Arrays of Arrow batches as numpy arrays and back, without Python objects per value. Shipped to the workers by value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def lengths_of(column: pa.ListArray) -> np.ndarray:
    return np.diff(column.offsets.to_numpy()).astype(np.int64)


def vectors(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (all vectors below each other) and vectors per entry of a column of arrays of equally long vectors."""
    inner = column.flatten()
    width = len(inner.flatten()) // len(inner) if len(inner) else 1
    return inner.flatten().to_numpy(zero_copy_only=False).reshape(len(inner), width), lengths_of(column)


def padded(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(entries, longest, features) values of rows that lie below each other, with zeros behind the end of an entry."""
    out = np.zeros((len(lengths), int(lengths.max()), rows.shape[1]))
    out[np.arange(out.shape[1])[None] < lengths[:, None]] = rows
    return out


def cut(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The rows below each other of padded values (entries, longest, ...): the inverse of ``padded``."""
    return values[np.arange(values.shape[1])[None] < lengths[:, None]]


def lists(values: pa.Array | np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values))


def arrays(rows: np.ndarray) -> pa.ListArray:
    """One array per row of a matrix."""
    return lists(np.ascontiguousarray(rows).ravel(), np.full(len(rows), rows.shape[1]))


def runs(lengths: np.ndarray, most: int, steps: int) -> Iterator[slice]:
    """Runs of entries in their order: at most ``most``, and number x longest at most ``steps`` (one entry at least)."""
    first, longest = 0, 0
    for i, n in enumerate(lengths.tolist()):
        longest = max(longest, n)
        if i > first and (i - first == most or (i - first + 1) * longest > steps):
            yield slice(first, i)
            first, longest = i, n
    if first < len(lengths):
        yield slice(first, len(lengths))
