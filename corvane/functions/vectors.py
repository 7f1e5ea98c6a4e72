"""Vectors in Arrow batches as numpy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def parse(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and float32 rows of the vectors that have ``dim`` finite numbers, not all zero."""
    v = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    i = ids.to_numpy(zero_copy_only=False) if isinstance(ids, pa.Array) else ids.to_numpy()
    size = np.nan_to_num(v.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1)
    at = np.flatnonzero(size == dim)
    x = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return i[at[ok]], x[ok]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision. A zero row stays zero."""
    d = x.astype(np.float64)
    top = np.abs(d).max(axis=1, keepdims=True, initial=0)
    d = d / np.where(top > 0, top, 1)
    n = np.sqrt((d * d).sum(axis=1, keepdims=True))
    return d / np.where(n > 0, n, 1)


def mix64(i: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of integers (the SplitMix64 finaliser)."""
    z = i.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))
