"""Repeated passages by a sparse suffix array.

Every window of ``passage`` words picks one of its suffixes: the one that starts with the least hash of
``passage // 3 + 1`` words (its minimiser).  The choice follows from the window's words alone, so equal windows pick
equal suffixes, and about one position in seventeen is retained.  A suffix knows the stretch of text that all windows
which picked it span.

Suffixes with equal stretches repeat over their whole stretch; one of them stands for them in what follows.  The
suffixes are sorted: by the hash of their first words, then by the words that follow.  Neighbours in this order are
compared for their longest common prefix, so suffixes that share any number of words to the right are a run of
neighbours.  Within a run matches are extended to the left, a word at a time: suffixes that share ``o`` words to the
left and the rest of a passage to the right hold that passage in common.

The sort is one over all rows, dealt by ranges that end anywhere, so a beginning with very many suffixes lies in many
tasks.  Only a run that holds the first or the last suffix of a task can go on in another one; windows in such runs send
their digests instead, which meet by a join.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_batch, free_name, id_and_text, stored, to_arrow
from .shingles import _P, WordHashes, grams

_SUFFIXES = "doc_id long, low int, high int, at int, start_key long, hi long, lo long"
_CONTEXTS = "doc_id long, at int, start_key long, right binary, left binary"
_EXTENDED = "doc_id long, start int, end int, skip int, hi long, lo long"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _digests(words: np.ndarray, lows, highs) -> np.ndarray:
    """Two 64-bit integers for each stretch words[low:high]."""
    data = memoryview(np.ascontiguousarray(words)).cast("B")
    joined = b"".join([xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(lows, highs)])
    return np.frombuffer(joined, dtype="<i8").reshape(-1, 2)


def retained(words: np.ndarray, passage: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The retained suffixes of a text: (start keys, first windows, last windows, places); a run of windows with one choice each."""
    span = passage - size + 1
    keys = grams(words, size)
    n = len(words) - passage + 1
    chosen = np.empty(n, dtype=np.int64)
    for at in range(0, n, 65_536):  # blocks bound the memory for very long texts
        view = np.lib.stride_tricks.sliding_window_view(keys[at : at + 65_536 + span - 1], span)[: n - at]
        chosen[at : at + len(view)] = view.argmin(axis=1) + np.arange(at, at + len(view))
    edges = np.flatnonzero(np.diff(chosen)) + 1
    first = np.concatenate([[0], edges])
    last = np.concatenate([edges - 1, [n - 1]])
    return keys[chosen[first]], first, last, chosen[first]


def suffixes(docs: DataFrame, passage: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each retained suffix: its windows' first and last start, its place, its first words' hash, its stretch's digest.

    Null, empty and short texts have none; repeated rows have theirs each; an empty table gives no rows.
    """

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            out = []
            rows = 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = (t.as_py() or "").encode("utf-8", "replace").split()
                if len(words) < passage:
                    continue
                w = hashes(words)
                keys, first, last, at = retained(w, passage, size)
                stretch = _digests(w, first.tolist(), (last + passage).tolist())
                out.append((i, first, last, keys, stretch, at))
                rows += len(keys)
                if rows > 50_000:
                    yield batch(out)
                    out, rows = [], 0
            if out:
                yield batch(out)

    def batch(out):
        stretch = np.concatenate([o[4] for o in out])
        whole = lambda k, kind: np.concatenate([o[k] for o in out]).astype(kind)
        ids = pa.array([o[0] for o in out], pa.int64()).take(pa.array(np.repeat(np.arange(len(out)), [len(o[1]) for o in out])))
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(whole(1, np.int32)),
                pa.array(whole(2, np.int32)),
                pa.array(whole(5, np.int32)),
                pa.array(np.concatenate([o[3] for o in out]).view(np.int64)),
                pa.array(stretch[:, 0].copy()),
                pa.array(stretch[:, 1].copy()),
            ],
            names=[c.split()[0] for c in _SUFFIXES.split(", ")],
        )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, _SUFFIXES)


def _contexts(docs: DataFrame, asked: DataFrame, passage: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """The words around suffixes (doc_id, stretches array of (low, high, at, start_key, hi, lo)), as hashes that sort as bytes.

    ``right`` has those behind the first ``size``, to the end of the stretch; ``left`` those before, from its beginning.
    """
    schema = to_arrow(docs.sparkSession, _CONTEXTS)

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            out = []
            for i, t, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                words = (t.as_py() or "").encode("utf-8", "replace").split()
                w = hashes(words)
                found = [f for f in found.as_py() if f["high"] + passage <= len(words)]
                digests = _digests(w, [f["low"] for f in found], [f["high"] + passage for f in found])
                data = w.astype(">u8").tobytes()
                for f, (hi, lo) in zip(found, digests.tolist()):
                    if (hi, lo) != (f["hi"], f["lo"]):
                        continue  # another row of this id
                    low, at, end = 8 * f["low"], 8 * f["at"], 8 * (f["high"] + passage)
                    out.append((i, f["at"], f["start_key"], data[at + 8 * size : end], data[low:at]))
                if len(out) > 5000:
                    yield as_batch(out, schema)
                    out = []
            if out:
                yield as_batch(out, schema)

    texts = id_and_text(docs, id_col, text_col).join(asked, "doc_id").select("doc_id", "text", "stretches")
    return texts.mapInArrow(run, _CONTEXTS)


@dataclass
class Suffixes:
    """Sorted suffixes in memory; ``words`` has ``around`` words before and as many behind the first ones, zeros where unknown."""

    doc: np.ndarray
    at: np.ndarray
    key: np.ndarray
    words: np.ndarray
    n_right: np.ndarray
    n_left: np.ndarray

    @classmethod
    def read(cls, b: pa.RecordBatch, around: int) -> "Suffixes":
        words = np.zeros((b.num_rows, 2 * around), dtype=np.uint64)
        n_right = _spread(b.column(3), words[:, around:], False)
        n_left = _spread(b.column(4), words[:, :around], True)
        doc, at, key = (b.column(i).to_numpy().astype(np.int64) for i in range(3))
        return cls(doc, at, key, words, n_right, n_left)

    def take(self, rows) -> "Suffixes":
        return Suffixes(*[getattr(self, f.name)[rows] for f in fields(self)])

    @staticmethod
    def joined(parts: list["Suffixes"]) -> "Suffixes":
        return Suffixes(*[np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Suffixes)])

    def __len__(self) -> int:
        return len(self.doc)


def _spread(column: pa.Array, out: np.ndarray, at_end: bool) -> np.ndarray:
    """Put binary values, runs of big-endian integers, into the rows of ``out``; their lengths."""
    column = column.cast(pa.binary())
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    lengths = np.diff(bounds) // 8
    if lengths.sum():
        row = np.repeat(np.arange(len(column)), lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        if at_end:
            place += (out.shape[1] - lengths)[row]
        out[row, place] = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]].view(">u8")
    return lengths.astype(np.int64)


def extended(s: Suffixes, passage: int, open_first: bool, open_last: bool) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray]]:
    """What the windows of a stretch of the sorted suffixes show.

    First (doc, first start, last start, skip) of runs of windows that stand twice or more; ``skip`` is -1 for windows
    that have no earlier place, see ``_skipped`` for others.  Then (row, words before the suffix) of the windows that
    suffixes before the first one, if ``open_first``, or behind the last one, if ``open_last``, may hold too.
    """
    around = s.words.shape[1] // 2
    right, reach = s.words[:, around:], np.minimum(s.n_right[1:], s.n_right[:-1])
    equal = (right[1:] == right[:-1]) & (np.arange(around) < reach[:, None])
    common = np.where(equal.all(axis=1), around, equal.argmin(axis=1))  # neighbours' common words behind the first ones
    common = np.where(s.key[1:] == s.key[:-1], common, -1)
    rank = np.empty(len(s), dtype=np.int64)
    rank[np.lexsort((s.at, s.doc))] = np.arange(len(s))
    left, power = np.zeros(len(s), dtype=np.uint64), 1
    rows, owners, starts, open_rows, open_before = ([np.zeros(0, dtype=np.int64)] for _ in range(5))
    for o in range(around + 1):  # windows that begin o words before the suffix
        run = np.concatenate([[0], np.cumsum(common < around - o)])
        is_open = (open_first & (run == 0)) | (open_last & (run == run[-1]))
        has = (s.n_right >= around - o) & (s.n_left >= o)
        open_rows.append(np.flatnonzero(has & is_open))
        open_before.append(np.full(len(open_rows[-1]), o))
        has = np.flatnonzero(has & ~is_open)
        if len(has) > 1:
            order = np.lexsort((rank[has], left[has], run[has]))
            here, run = has[order], run[has][order]
            fresh = np.concatenate([[True], (run[1:] != run[:-1]) | (left[here][1:] != left[here][:-1])])
            group = np.cumsum(fresh) - 1
            twice = np.bincount(group)[group] > 1
            rows.append(here[twice])
            owners.append(here[fresh][group][twice])
            starts.append(np.full(int(twice.sum()), -o))
        if o < around:
            left += s.words[:, around - 1 - o] * np.uint64(power)
            power = power * int(_P) % 2**64
    row, owner = np.concatenate(rows), np.concatenate(owners)
    start = np.concatenate(starts) + s.at[row]
    doc, first = s.doc[row], start + s.at[owner] - s.at[row]
    same = doc == s.doc[owner]
    skip = np.where(same & (first == start), -1, np.where(same, np.maximum(first + passage - start, 0), 0))
    order = np.lexsort((start, doc))
    doc, start, skip = doc[order], start[order], skip[order]
    breaks = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (skip[1:] != skip[:-1])
    opens = np.concatenate([[True], breaks])[: len(doc)]
    closes = np.concatenate([breaks, [True]])[: len(doc)]
    return (doc[opens], start[opens], start[closes], skip[opens]), (np.concatenate(open_rows), np.concatenate(open_before))


def _extensions(contexts: DataFrame, passage: int, group_rows: int) -> DataFrame:
    """Sort, compare neighbours, extend: spans (skip null for own first places), and digests of windows that other tasks may hold."""
    around = passage - (passage // 3 + 1)
    schema = to_arrow(contexts.sparkSession, _EXTENDED)

    def told(s: Suffixes, open_first: bool, open_last: bool):
        (doc, first, last, skip), (rows, before) = extended(s, passage, open_first, open_last)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc),
                pa.array(first.astype(np.int32)),
                pa.array((last + passage).astype(np.int32)),
                pa.array(skip.astype(np.int32), mask=skip < 0),
                pa.nulls(len(doc), pa.int64()),
                pa.nulls(len(doc), pa.int64()),
            ],
            schema=schema,
        )
        for k in range(0, len(rows), 20_000):
            out = []
            for i, o in zip(rows[k : k + 20_000].tolist(), before[k : k + 20_000].tolist()):
                window = s.words[i, around - o : 2 * around - o].tobytes()
                digest = xxhash.xxh3_128_digest(window, int(s.key[i]) & (2**64 - 1))
                start = int(s.at[i]) - o
                out.append((int(s.doc[i]), start, start + passage, None, *struct.unpack("<qq", digest)))
            yield as_batch(out, schema)

    def run(batches):
        held, size, open_first = [], 0, True  # suffixes alike may stand in the tasks before and behind
        for b in batches:
            if not b.num_rows:
                continue
            held.append(Suffixes.read(b, around))
            size += b.num_rows
            if size > group_rows:
                s = Suffixes.joined(held)
                end = int(np.flatnonzero(s.key == s.key[-1])[0])  # where the last beginning's suffixes begin
                cut = end or len(s) - 1  # one beginning's suffixes fill the memory meant for them: cut among them
                yield from told(s.take(slice(0, cut)), open_first, not end)
                open_first, held = not end, [s.take(slice(cut, None))]
                size = len(held[0])
        if held:
            yield from told(Suffixes.joined(held), open_first, True)

    order = ["start_key", "right", "doc_id", "at"]
    tasks = max(1, -(-contexts.count() // group_rows))  # the fewer the ends of tasks, the fewer the runs that go on
    return contexts.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(run, _EXTENDED)


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def minus(spans: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for a, b in spans:
        for c, d in others:
            if d <= a or c >= b:
                continue
            if c > a:
                out.append((a, c))
            a = max(a, d)
            if a >= b:
                break
        if a < b:
            out.append((a, b))
    return out


def _skipped(doc_id: Column, at: Column, first_doc: Column, first_at: Column, passage: int) -> Column:
    """How many words a window or stretch shares with its first place where they overlap; null for the first place."""
    same = doc_id == first_doc
    return F.when(same & (at == first_at), F.lit(None)).when(same, F.greatest(F.lit(0), first_at + passage - at)).otherwise(F.lit(0))


_SPANS = "doc_id long, n_repeat_words long, n_cut_words long, repeats array<struct<start:int,end:int>>, cuts array<struct<start:int,end:int>>"


def repeated_passages(
    docs: DataFrame, passage: int = 50, id_col: str = "doc_id", text_col: str = "text", group_rows: int = 20_000
) -> DataFrame:
    """One row per document that holds a passage of ``passage`` or more words standing elsewhere too.

    Words are runs of characters other than ASCII white space, compared exactly.  ``repeats`` are the maximal stretches
    (in words, end exclusive) all of whose windows of ``passage`` words occur twice or more in the table, in one
    document or several; ``cuts`` are the parts to remove so that of each window only the first place stays, the one in
    the document with the least id.  Words of windows a document is first to hold stay where that leaves no window
    twice.  Where it would (a passage of fewer than ``2 * passage - 1`` words inside a longer stretch that the document
    is first to hold is all covered by such windows), the windows with an earlier place are cut whole.

    Documents without repeats, and null, empty and short texts, have no row.  Rows with one doc_id are one document: the
    place with the least id is then in all of them and none is cut for another.  Rows without a doc_id are left out.  An
    empty table gives an empty result; other columns are ignored.  About ``group_rows`` sorted suffixes are in a task's
    memory at a time, whatever number one beginning has.
    """
    size = passage // 3 + 1
    every = stored(suffixes(docs.filter(docs[id_col].isNotNull()), passage, size, id_col, text_col), "suffixes")
    # written first: a join with a finished table can be split where one beginning has very many suffixes
    beginnings = stored(every.groupBy("start_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("start_key"), "beginnings")
    near = stored(every.join(beginnings, "start_key"), "neighbours")

    classes = stored(
        near.groupBy("start_key", "hi", "lo").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "low", "high", "at")).alias("first")
        ),
        "stretch-classes",
    )
    mixed = stored(classes.groupBy("start_key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("start_key"), "mixed-beginnings")
    asked = (
        classes.join(mixed, "start_key")
        .select("first.doc_id", F.struct("first.low", "first.high", "first.at", "start_key", "hi", "lo").alias("s"))
        .groupBy("doc_id")
        .agg(F.collect_set("s").alias("stretches"))  # within one document
    )
    contexts = stored(_contexts(docs, asked, passage, size, id_col, text_col), "contexts")
    found = stored(_extensions(contexts, passage, group_rows), "extensions")
    open_windows = found.filter("hi is not null")
    places = stored(
        open_windows.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start")).alias("owner")).filter("n > 1"),
        "window-places",
    )
    skip = _skipped(F.col("doc_id"), F.col("start"), F.col("owner.doc_id"), F.col("owner.start"), passage)
    met = open_windows.drop("skip").join(places, ["hi", "lo"]).select("doc_id", "start", "end", skip.alias("skip"))
    extensions = found.filter("hi is null").select("doc_id", "start", "end", "skip").unionByName(met)
    whole = (
        near.join(classes.filter("n > 1"), ["start_key", "hi", "lo"])
        .select(
            near["doc_id"],
            near["low"].alias("start"),
            (near["high"] + passage).alias("end"),
            _skipped(near["doc_id"], near["low"], F.col("first.doc_id"), F.col("first.low"), passage).alias("skip"),
        )
    )
    spans = whole.unionByName(extensions)
    lists = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", "skip")).alias("spans"))
    schema = to_arrow(docs.sparkSession, _SPANS)

    def join_spans(batches):
        for b in batches:
            out = []
            for i, found in zip(b.column(0).to_pylist(), b.column(1)):
                found = [(s["start"], s["end"], s["skip"]) for s in found.as_py()]
                repeats = union([(a, z) for a, z, _ in found])
                earlier = {(a, z) for a, z, skip in found if skip is not None}
                kept = union([(a, z) for a, z, skip in found if skip is None])
                cuts = minus(union(sorted(earlier)), _owned(kept, earlier, passage))
                cuts = union(cuts + _left_whole(found, cuts, passage))
                as_rows = lambda x: [{"start": a, "end": z} for a, z in x]
                length = lambda x: sum(z - a for a, z in x)
                out.append((i, length(repeats), length(cuts), as_rows(repeats), as_rows(cuts)))
            yield as_batch(out, schema)

    return lists.mapInArrow(join_spans, _SPANS)


def _owned(kept, cut_windows, passage) -> list[tuple[int, int]]:
    """What stays of a document's own first places: their stretches without the windows that have an earlier place."""
    inner = union([(a, z - passage + 1) for a, z in cut_windows])  # starts of windows with an earlier place
    starts = minus([(a, z - passage + 1) for a, z in kept], inner)
    return union([(a, z + passage - 1) for a, z in starts])


def _left_whole(found, cuts, passage) -> list[tuple[int, int]]:
    """The words of windows with an earlier place that the cuts leave whole, without the first ``skip`` of each."""
    hit = union([(a - passage + 1, z) for a, z in cuts])  # starts of windows that the cuts reach
    starts: dict[int, list[tuple[int, int]]] = {}
    for a, z, skip in found:
        if skip is not None:
            starts.setdefault(skip, []).append((a, z - passage + 1))
    return [(a + skip, z + passage - 1) for skip, spans in starts.items() for a, z in minus(union(spans), hit)]


def without_cuts(docs: DataFrame, cuts: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with the cut words removed from their texts; rows that have no word left by that are gone.

    Rows without cuts stay as they are, also those with a null or empty text or without an id; rows of one id are cut
    alike, as far as their texts reach; an empty table gives an empty result; columns of any other name stay.
    """
    at, name = columns.index(text_col), free_name(columns, "cuts")
    joined = docs.select(*columns).join(cuts.select(F.col("doc_id").alias(id_col), F.col("cuts").alias(name)), id_col, "left").select(*columns, name)

    def run(batches):
        for b in batches:
            found = b.column(len(columns))
            keep, texts = [], []
            for row in range(b.num_rows):
                spans = found[row].as_py()
                text = b.column(at)[row].as_py()
                if spans:
                    text = cut_words(text or "", [(s["start"], s["end"]) for s in spans])
                    if not text.split():
                        continue
                keep.append(row)
                texts.append(text)
            kept = b.take(pa.array(keep, pa.int64()))
            arrays = [pa.array(texts, b.schema.field(at).type) if c == at else kept.column(c) for c in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([b.schema.field(c) for c in range(len(columns))]))

    return joined.mapInArrow(run, docs.select(*columns).schema)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (in words) and the white space after each of them."""
    data = text.encode("utf-8", "replace")
    begins = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    out, at = [], 0
    for a, z in spans:
        if a >= len(begins) - 1:
            break  # a row of that id with a shorter text
        out.append(data[at : begins[a]])
        at = begins[min(z, len(begins) - 1)]
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "replace")
