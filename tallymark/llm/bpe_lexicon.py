"""BPE encoding and decoding through a lexicon of the corpus's frequent words.

One pass counts white-space-free chunks over all rows; the words of the ``lexicon_words`` most frequent chunks are
merged once and compiled into a minimal acyclic transducer of bounded size.  The encoding pass maps it into memory,
looks up each batch's distinct words in it, and merges the others exactly.  The lexicon only saves work: any lexicon
gives the same ids.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter
from collections.abc import Iterable
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_words
from .common import id_and_text, stored
from .transducer import EDGE_BYTES, Transducer, compile_words

MAX_LEXICON_BYTES = 64 << 20


class Merges:
    """Exact byte-pair merging: the pair of the least rank first, the leftmost of equals."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self._vocab = model["vocab"]
        self._end = model.get("end_of_word_suffix") or ""
        pairs = (m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"])
        self._rank = {tuple(p): i for i, p in enumerate(pairs)}

    def ids(self, word: str) -> tuple[int, ...]:
        symbols = list(token_words.spelled(word))
        if not symbols:
            return ()
        symbols[-1] += self._end
        symbols = self._short(symbols) if len(symbols) <= 48 else self._long(symbols)
        return tuple([self._vocab[s] for s in symbols])

    def _short(self, symbols: list[str]) -> list[str]:
        rank, none = self._rank.get, len(self._rank)
        ranks = [rank(pair, none) for pair in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank((symbols[at], symbols[at + 1]), none)
            if at:
                ranks[at - 1] = rank((symbols[at - 1], symbols[at]), none)
        return symbols

    def _long(self, symbols: list[str]) -> list[str]:
        """The same for long words, with a queue of pairs over a linked list."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                r = self._rank.get((symbols[i], symbols[j]))
                if r is not None:
                    heapq.heappush(queue, (r, i, symbols[i], symbols[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = left + right, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s in symbols if s]


def _chunk_counts(batches):
    import pyarrow as pa

    counts: Counter = Counter()

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["chunk", "n"])
        counts.clear()
        return batch

    for b in batches:
        for text in b.column(0):
            text = text.as_py()
            if text:
                counts.update(text.lower().split())
            if len(counts) > 300_000:
                yield flush()
    if counts:
        yield flush()


def frequent_words(docs: DataFrame, text_col: str, tokenizer_path: str, lexicon_words: int) -> list[str]:
    """Words of the most frequent chunks over all rows.

    Chunks are ranked by bands of frequency, 32 to each doubling.  The driver gets the bands' sizes, then the highest
    bands that hold at most ``lexicon_words`` chunks together.  Chunks of one place or over 64 characters are left out.
    """
    counts = (
        docs.select(docs[text_col].cast("string").alias("text"))
        .mapInArrow(_chunk_counts, "chunk string, n long")
        .filter(F.length("chunk") <= 64)
        .groupBy("chunk")
        .agg(F.sum("n").alias("n"))
        .filter("n > 1")
        .withColumn("band", F.floor(F.log2("n") * 32).cast("int"))
    )
    counts = stored(counts, "chunk-counts")
    least, room = None, lexicon_words
    for row in sorted(counts.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if row["n"] > room:
            break
        least, room = row["band"], room - row["n"]
    chunks = counts.filter(F.col("band") >= least).select("chunk", "n").collect() if least is not None else []
    splitter = token_words.load(tokenizer_path)[2]()
    weights: Counter = Counter()
    for row in chunks:
        for word in splitter.words(row["chunk"]):
            weights[word] += row["n"]
    return [w for w, _ in sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:lexicon_words]]


def lexicon(words: Iterable[str], tokenizer_path: str, max_bytes: int = MAX_LEXICON_BYTES) -> bytes:
    """The compiled words, given from the most frequent on, as far as ``max_bytes`` surely hold them.

    A word takes at most an edge and a state for each of its bytes, and its ids; shared ends take less.
    """
    merges = Merges(token_words.load(tokenizer_path)[1])
    entries, size = {}, 256
    for w in words:
        key, ids = w.encode("utf-8", "replace"), merges.ids(w)
        size += EDGE_BYTES * len(key) + 4 * len(ids) + 4
        if size > max_bytes:
            break
        entries[key] = ids
    return compile_words(entries)


class Encoder:
    """Ids of texts, for one task: the lexicon first, exact merges for what it lacks."""

    def __init__(self, tokenizer_path: str, data: bytes, memo_words: int = 300_000):
        tokenizer, spec, maker = token_words.load(tokenizer_path)
        self._splitter, self._merges = maker(), Merges(spec)
        self._lexicon = Transducer.mapped(data)
        self._memo: dict[str, tuple[int, ...]] = {}
        self._numbers: dict[str, str] = {}
        self._decoded: dict[str, str] = {}
        self._memo_words = memo_words
        self._tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}

    def _learn(self, words: set[str]) -> None:
        fresh = words.difference(self._memo)
        if len(self._memo) + len(fresh) > self._memo_words:
            for memo in (self._memo, self._numbers, self._decoded):
                memo.clear()
            fresh = words
        fresh = list(fresh)
        for word, rank in zip(fresh, self._lexicon.ranks([w.encode("utf-8", "replace") for w in fresh]).tolist()):
            self._memo[word] = self._lexicon.ids(rank) if rank >= 0 else self._merges.ids(word)

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        parts = [self._splitter.parts(t) for t in texts]
        words: set[str] = set()
        for part in parts:
            words.update(*[p for p in part if not isinstance(p, int)])
        self._learn(words)
        ids = self._memo.__getitem__
        out = []
        for part in parts:
            one: list[int] = []
            for p in part:
                if isinstance(p, int):
                    one.append(p)
                else:
                    one.extend(chain.from_iterable(map(ids, p)))
            out.append(one)
        return out

    def written_many(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: its number of tokens, its ids with a space between them, and these ids decoded.

        Decoding puts a space between tokens, so what a text's ids give is what its words' ids give, one after another.
        """
        parts = [self._splitter.parts(t) for t in texts]
        words: set[str] = set()
        for part in parts:
            words.update(*[p for p in part if not isinstance(p, int)])
        self._learn(words)
        for word in words.difference(self._numbers):
            ids = self._memo[word]
            self._numbers[word] = " ".join(map(str, ids))
            self._decoded[word] = self.decode(ids)
        out = []
        for part in parts:
            numbers: list[str] = []
            decoded: list[str] = []
            for p in part:
                if isinstance(p, int):
                    numbers.append(str(p))
                    decoded.append(self.decode([p]))
                else:
                    numbers.extend(map(self._numbers.__getitem__, p))
                    decoded.extend(map(self._decoded.__getitem__, p))
            joined = " ".join(numbers)
            out.append((joined.count(" ") + 1 if joined else 0, joined, " ".join(decoded)))
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens with a space between them."""
        return " ".join(map(self._tokens.__getitem__, ids))


def encode(
    docs: DataFrame, tokenizer_path: str, lexicon_words: int = 60_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids, decoded) of every row.

    Null text is encoded as empty: no ids, an empty decoded text.  Repeated rows are encoded each, an empty table
    gives an empty result, other columns are ignored.  Memory follows a group of texts of a few megabytes, or one
    longer text.
    """

    def rows(encoder, texts):
        return [(ids, encoder.decode(ids)) for ids in encoder.encode_many(texts)]

    return _encoded(docs, tokenizer_path, lexicon_words, id_col, text_col, "doc_id long, ids array<int>, decoded string", rows)


def encode_digests(
    docs: DataFrame, tokenizer_path: str, lexicon_words: int = 60_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, without moving ids between processes."""

    def digests(encoder, texts):
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
        return [(n, sha(ids), sha(decoded)) for n, ids, decoded in encoder.written_many(texts)]

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _encoded(docs, tokenizer_path, lexicon_words, id_col, text_col, schema, digests)


def _encoded(docs, tokenizer_path, lexicon_words, id_col, text_col, schema, shape) -> DataFrame:
    from .common import as_batch, to_arrow

    words = frequent_words(docs, text_col, tokenizer_path, lexicon_words)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(words, tokenizer_path))
    arrow_schema = to_arrow(docs.sparkSession, schema)

    def run(batches):
        encoder = None
        for b in batches:
            if not b.num_rows:
                continue
            encoder = encoder or Encoder(tokenizer_path, shared.value)
            ids, texts, size = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size > 2_000_000:
                    yield as_batch(rows(encoder, ids, texts), arrow_schema)
                    ids, texts, size = [], [], 0
            if ids:
                yield as_batch(rows(encoder, ids, texts), arrow_schema)

    def rows(encoder, ids, texts):
        return [(i, *values) for i, values in zip(ids, shape(encoder, texts))]

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
