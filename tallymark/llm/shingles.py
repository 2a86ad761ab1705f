"""Hashes of words and of runs of words, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, through a bounded memo; for one task."""

    def __init__(self, memo_words: int = 300_000):
        self._memo: dict[bytes, int] = {}
        self._memo_words = memo_words

    def __call__(self, words: list[bytes]) -> np.ndarray:
        fresh = set(words).difference(self._memo)
        if fresh:
            if len(self._memo) > self._memo_words:
                self._memo.clear()
                fresh = set(words)
            self._memo.update((w, xxhash.xxh3_64_intdigest(w)) for w in fresh)
        return np.fromiter(map(self._memo.__getitem__, words), dtype=np.uint64, count=len(words))


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(words) - size + 1
    acc = words[:n].copy()
    for i in range(1, size):
        acc = acc * _P + words[i : i + n]
    return mixed(acc + np.uint64(size))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingles; fewer words than ``size`` are one shingle, no words none."""
    if not len(words):
        return words
    return np.unique(grams(words, min(size, len(words))))
