"""Hashes of words and word windows as numpy arrays, for code that runs in Python workers."""

from __future__ import annotations

import numpy as np
import xxhash


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits each depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """The 64-bit hash of every run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(n, (0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(width):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
        acc ^= acc >> np.uint64(32)
    return mixed(acc)
