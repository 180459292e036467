"""Hashes of words and of runs of words, without building the runs."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

SEED = 42


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Iterable[bytes | str], n: int = -1) -> np.ndarray:
    """A 64-bit hash of each word, ``n`` of them where the number is known."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)


def run_hashes(own: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word hashes in a row; all as one run where there are fewer."""
    n = max(1, len(own) - size + 1)
    out = np.full(n, SEED, np.uint64)
    for k in range(min(size, len(own))):
        out = mixed(out) + own[k : k + n]
    return mixed(out)
