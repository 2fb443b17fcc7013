"""Arrays packed into binary columns, for exchanges between chunks of rows
and the owners of keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard


def packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpacked(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def packed_rising(keys: np.ndarray) -> bytes:
    """Rising integers by their differences, byte plane by byte plane: the
    planes that are all zero cost nothing."""
    steps = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    return packed(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def unpacked_rising(b: bytes) -> np.ndarray:
    planes = unpacked(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def by_owner(hashes: np.ndarray, owners: int, empty: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(owner, places in ``hashes`` of its keys in rising order) for each
    owner that has any, or for each with ``empty``."""
    owner = (hashes % np.uint64(owners)).astype(np.int64)
    order = np.lexsort((hashes, owner))
    edges = np.searchsorted(owner[order], np.arange(owners + 1))
    for o in range(owners):
        if empty or edges[o] < edges[o + 1]:
            yield o, order[edges[o] : edges[o + 1]]
