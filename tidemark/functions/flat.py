"""Arrow columns of bytes as one flat array, so that whole batches are read and made by vector operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are worked on together.
STRETCH = 4 << 20


def flat(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values end to end, and where each begins and the last ends; null is empty."""
    if not len(data):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = data.cast(pa.binary()) if data.type != pa.binary() else data
    data = data.fill_null(b"") if data.null_count else data
    _, places, raw = data.buffers()
    at = np.frombuffer(places, np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def binaries(raw: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Values of the given sizes, cut from their bytes end to end."""
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw))])


def stretches(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about STRETCH bytes each, one row at least."""
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + STRETCH, "right")) - 1)
        yield low, high
        low = high


def within(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the stretches from begin to end, none of which overlap."""
    return np.cumsum(np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n] > 0


def numbers(column: pa.Array, none: int = 0) -> np.ndarray:
    """Whole numbers, with `none` for null."""
    return np.asarray(column.cast(pa.int64()).fill_null(none), np.int64)


def repeated(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each group as often as it has members, and each member's number in its group."""
    return np.repeat(np.arange(len(sizes)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
