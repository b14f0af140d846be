"""Word and word-run hashing shared by the overlap operators (NumPy, one call per Arrow batch)."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[A-Za-z0-9_]+")
_CACHE_BOUND = 250_000


class _Hashes(dict):
    """Word -> 64-bit hash; emptied at a bound so that a worker's memory stays flat."""

    def __missing__(self, w: str) -> int:
        if len(self) >= _CACHE_BOUND:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w.lower())
        return h


_HASHES = _Hashes()


def words(text: str | None) -> list[str]:
    """Maximal runs of ``[A-Za-z0-9_]``; NULL has none. Case is folded when hashing."""
    return WORD.findall(text) if text else []


def hash_words(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, ws), dtype=np.uint64, count=len(ws))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words in order; empty if there are fewer words."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    m = len(h) - n + 1
    acc = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m])
    return acc
