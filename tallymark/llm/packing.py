"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A bin is filled greedily, largest fitting document first; then its smallest document is replaced by the two unpacked
documents that fit the gap so widened most tightly, as long as that leaves less empty.  Only lengths matter for this,
and there are at most ``capacity`` of them: bins are planned over the histogram of lengths, each planned bin as often
as its lengths last.  The plan's size depends on the capacity alone, for any number of documents; documents then take
their places in it by their rank among those of their length.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import token_words
from .common import as_batch, id_and_text, stored, to_arrow

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, place long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class IdBytes:
    """Ids of texts as little-endian 32-bit integers, for one process.

    Plain texts are merged by ranks where the vocabulary allows it.  Others, and those over ``long_chars`` characters,
    go word by word through the library, with a bounded memo of words: an expression with backtracking doesn't bear
    very long runs of white space.
    """

    def __init__(self, tokenizer_path: str, memo_words: int = 300_000, long_chars: int = 100_000):
        self._tokenizer, spec, maker = token_words.load(tokenizer_path)
        self._splitter = maker()
        self._by_rank = token_words.rank_encoder(self._tokenizer, spec)
        self._memo: dict[str, bytes] = {}
        self._memo_words, self._long_chars = memo_words, long_chars

    def __call__(self, text: str) -> bytes:
        if self._by_rank is not None and len(text) <= self._long_chars and self._splitter.plain(text):
            return _packed_ids(self._by_rank(text))
        out = []
        for part in self._splitter.parts(text):
            if isinstance(part, int):
                out.append(part.to_bytes(4, "little"))
                continue
            fresh = list(set(part).difference(self._memo))
            if fresh:
                if len(self._memo) > self._memo_words:
                    self._memo.clear()
                    fresh = list(set(part))
                codes = self._tokenizer.encode_batch_fast(fresh, add_special_tokens=False)
                self._memo.update((w, _packed_ids(c.ids)) for w, c in zip(fresh, codes))
            out.append(b"".join(map(self._memo.__getitem__, part)))
        return b"".join(out)


def _packed_ids(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(maxsize=2)
def _id_bytes(tokenizer_path: str) -> IdBytes:
    """One for all tasks of a worker process."""
    return IdBytes(tokenizer_path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of each document with their place among the task's pieces of equal length; ids are not kept."""
    schema = to_arrow(docs.sparkSession, _PIECES)

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part = TaskContext.get().partitionId()
        ids_of = None
        places = [0] * (capacity + 1)
        out = []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids_of = ids_of or _id_bytes(tokenizer_path)
                data = ids_of(text.as_py() or "") + b"\0\0\0\0"
                n = len(data) // 4
                start = 0
                for k in range(-(-n // capacity)):
                    length = (n % capacity or capacity) if k == 0 else capacity
                    out.append((doc_id, k, start, length, zlib.crc32(memoryview(data)[4 * start : 4 * (start + length)]), part, places[length]))
                    places[length] += 1
                    start += length
                if len(out) > 5000:
                    yield as_batch(out, schema)
                    out = []
        if out:
            yield as_batch(out, schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, _PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, how many such bins), by best-two-fit over the histogram ``counts`` of lengths."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        left[length] = n
    lengths = np.arange(capacity + 1)

    def fitting() -> np.ndarray:
        """The largest length left of at most each length, 0 if none."""
        return np.maximum.accumulate(np.where(left > 0, lengths, 0))

    bins = []
    while True:
        first = int(fitting()[capacity])
        if not first:
            return bins
        taken = [first]
        left[first] -= 1
        gap = capacity - first
        while gap and (fit := int(fitting()[gap])):
            taken.append(fit)
            left[fit] -= 1
            gap -= fit
        while gap and len(taken) > 1:
            small = min(taken)
            room = gap + small
            best = fitting()
            x = lengths[1:room][left[1:room] > 0]
            y = best[room - x]
            same = (y == x) & (left[x] < 2)
            y = np.where(same, best[np.maximum(x - 1, 0)], y)
            sums = np.where(y > 0, x + y, 0)
            if not len(sums) or sums.max() <= small:
                break
            at = int(sums.argmax())
            taken.remove(small)
            left[small] += 1
            for item in (int(x[at]), int(y[at])):
                taken.append(item)
                left[item] -= 1
            gap = room - int(sums[at])
        for item in taken:
            left[item] += 1
        used = np.bincount(taken, minlength=capacity + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= times * used
        bins.append((tuple(taken), times))


def places(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first ranks of its runs, what to add to a rank for the sequence's number, the offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    next_rank: dict[int, int] = {}
    base = 0
    for taken, times in bins:
        offset = 0
        for length in taken:
            rank = next_rank.get(length, 0)
            runs.setdefault(length, []).append((rank, base - rank, offset))
            next_rank[length] = rank + times
            offset += length
        base += times
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for n, r in runs.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its ids and a closing id 0; only one longer than ``capacity`` is cut, its remainder first.  Null and
    empty texts are a closing id alone; repeated rows are packed each; an empty table gives an empty result; other
    columns are ignored.  The driver holds one count per length and the plan made from it.
    """
    held = stored(pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    by_part = stored(held.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = places(plan(counts, capacity))

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_part.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))).drop("n")
    # both sides grow with the number of tasks, so neither is broadcast; no (part, length) holds more than a task's pieces
    ranked = held.join(shifts.hint("merge"), ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("shift")).alias("rank")
    )
    schema = to_arrow(docs.sparkSession, _PLACED)

    def place(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for n in np.unique(length).tolist():
                first, add, at = slots[n]
                rows = length == n
                run = np.searchsorted(first, rank[rows], side="right") - 1
                sequence[rows] = rank[rows] + add[run]
                offset[rows] = at[run]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(length.astype(np.int64)), b.column(4), pa.array(sequence), pa.array(offset)],
                schema=schema,
            )

    return ranked.mapInArrow(place, _PLACED)
