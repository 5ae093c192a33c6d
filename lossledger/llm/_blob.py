"""Compact byte strings for integer arrays: byte planes (of differences, where sorted) under a fast compressor.

Millions of numbers then cross a shuffle as a few large rows instead of as a row each.
"""

from __future__ import annotations

import numpy as np
import zstandard

_C = zstandard.ZstdCompressor(level=1)
_D = zstandard.ZstdDecompressor()


def pack(a: np.ndarray) -> bytes:
    """Any array of numbers, by byte planes."""
    a = np.ascontiguousarray(a)
    head = a.dtype.str.encode().ljust(4)
    return head + _C.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())


def unpack(b: bytes) -> np.ndarray:
    dtype = np.dtype(bytes(b[:4]).decode().strip())
    planes = np.frombuffer(_D.decompress(bytes(b[4:])), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit values."""
    d = a.astype(np.uint64)
    d[1:] -= a[:-1].astype(np.uint64)
    return pack(d)


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the least unsigned type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def count_sorted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs (or the sum of its weights)."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.append(at, len(keys))) if weights is None else np.add.reduceat(weights, at)
