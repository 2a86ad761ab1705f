"""A minimal acyclic transducer from words to id lists.

Words that end alike share states, and a transition's output is the number of listed words that come before those
behind it.  The outputs along a word sum to its rank, and the rank gives its ids.  All of it is a few flat arrays in
one file, which readers memory-map; lookups walk many words at once, a byte a step.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Sequence

import numpy as np

_MAGIC = b"TLYMFST1"
EDGE_BYTES = 13  # an edge's key, target and output, and the state behind it


def compile_words(entries: dict[bytes, Sequence[int]]) -> bytes:
    """The file's bytes for words and their ids. Work and size follow the number of entries, which callers bound."""
    words = sorted(entries)
    registry: dict[tuple, int] = {}
    edges: list[tuple[tuple[int, int], ...]] = []
    final: list[bool] = []

    def frozen(node: list) -> int:
        key = (node[0], tuple(node[1]))
        state = registry.get(key)
        if state is None:
            state = registry[key] = len(edges)
            edges.append(key[1])
            final.append(key[0])
        return state

    path: list[list] = [[False, []]]  # open nodes along the last word: is final, finished edges
    letters: list[int] = []
    for word in words:
        common = 0
        while common < min(len(word), len(letters)) and word[common] == letters[common]:
            common += 1
        while len(letters) > common:
            child = frozen(path.pop())
            path[-1][1].append((letters.pop(), child))
        for b in word[common:]:
            letters.append(b)
            path.append([False, []])
        path[-1][0] = True
    while letters:
        child = frozen(path.pop())
        path[-1][1].append((letters.pop(), child))
    start = frozen(path[0])

    below = np.zeros(len(edges), dtype=np.int64)  # children have smaller numbers than parents
    keys, targets, outputs = [], [], []
    for state, out in enumerate(edges):
        passed = int(final[state])
        for b, child in out:
            keys.append(state << 8 | b)
            targets.append(child)
            outputs.append(passed)
            passed += int(below[child])
        below[state] = passed
    lists = [list(entries[w]) for w in words]
    arrays = [
        np.array(keys, dtype=np.uint32),
        np.array(targets, dtype=np.uint32),
        np.array(outputs, dtype=np.uint32),
        np.array(final, dtype=np.uint8),
        np.cumsum([0, *map(len, lists)]).astype(np.uint32),
        np.array([i for x in lists for i in x], dtype=np.uint32),
    ]
    head = np.array([start, *map(len, arrays)], dtype=np.uint64)
    return _MAGIC + head.tobytes() + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


class Transducer:
    """A compiled lexicon, read in place from a mapped file or from bytes."""

    def __init__(self, buffer):
        view = memoryview(buffer)
        if bytes(view[:8]) != _MAGIC:
            raise ValueError("not a compiled lexicon")
        head = np.frombuffer(view, dtype=np.uint64, count=7, offset=8).astype(int)
        at, arrays = 8 + 56, []
        for n, kind in zip(head[1:], (np.uint32, np.uint32, np.uint32, np.uint8, np.uint32, np.uint32)):
            arrays.append(np.frombuffer(view, dtype=kind, count=int(n), offset=at))
            at += arrays[-1].nbytes + (-arrays[-1].nbytes % 8)
        self._start = int(head[0])
        self._keys, self._targets, self._outputs, self._final, self._offsets, self._ids = arrays

    @classmethod
    def mapped(cls, data: bytes) -> "Transducer":
        """Map the lexicon from a file that has no name any more, so that no file outlives the process.

        The file is local to the machine on purpose: it is the memory of this process, backed by pages that can be
        dropped and read again, and no other process ever looks for it.
        """
        fd, path = tempfile.mkstemp(prefix="lexicon-")
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(data)
            with open(path, "rb") as f:
                return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        finally:
            os.unlink(path)

    def ranks(self, words: Sequence[bytes]) -> np.ndarray:
        """Each word's rank among the listed words, -1 for others."""
        n = len(words)
        out = np.full(n, -1, dtype=np.int64)
        if not n or not len(self._final):
            return out
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        text = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8)
        begins = np.cumsum(lengths) - lengths
        live = np.arange(n)
        state = np.full(n, self._start, dtype=np.uint32)
        total = np.zeros(n, dtype=np.int64)
        step = 0
        while len(live):
            ended = lengths[live] == step
            if ended.any():
                done = live[ended]
                good = self._final[state[done]] == 1
                out[done[good]] = total[done[good]]
                live = live[~ended]
            if not len(live) or not len(self._keys):
                break
            key = state[live] << np.uint32(8) | text[begins[live] + step]
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            known = self._keys[at] == key
            live, at = live[known], at[known]
            state[live] = self._targets[at]
            total[live] += self._outputs[at]
            step += 1
        return out

    def ids(self, rank: int) -> tuple[int, ...]:
        return tuple(self._ids[self._offsets[rank] : self._offsets[rank + 1]].tolist())
