"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad.  A line's features describe it and its two neighbours; the chain's transitions say how states
follow one another.  Forward-backward marginals of the good state, weighted by the lines' lengths, average to the
document's score.  The field is fitted by gradient ascent on a bounded sample of labelled documents, each of whose lines
carries its document's label.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

_CLASSES = ("lower", "upper", "digit", "space", "stop", "bang", "bar", "mark", "beyond", "other")


def _table() -> np.ndarray:
    t = np.full(256, _CLASSES.index("other"), dtype=np.int64)
    for name, chars in (("space", b" \t\r\x0b\x0c"), ("stop", b".,;:?"), ("bang", b"!"), ("bar", b"|"), ("mark", b"#*$%&<>@^~_=+\\")):
        for c in chars:
            t[c] = _CLASSES.index(name)
    t[ord("a") : ord("z") + 1] = _CLASSES.index("lower")
    t[ord("A") : ord("Z") + 1] = _CLASSES.index("upper")
    t[ord("0") : ord("9") + 1] = _CLASSES.index("digit")
    t[0x80:] = _CLASSES.index("beyond")
    return t


_OWN = len(_CLASSES) + 6
N_FEATURES = 3 * _OWN + 3


def lines_of(data: bytes) -> list[bytes]:
    return [x for x in data.split(b"\n") if x.split(None, 1)]


def own_measures(lines: list[bytes], table: np.ndarray, seen: set[bytes] | None = None) -> np.ndarray:
    """A row of measures for each line; ``seen`` has earlier lines of the document and gains these."""
    n, k = len(lines), len(_CLASSES)
    own = np.zeros((n, _OWN))
    if not n:
        return own
    lengths = np.fromiter(map(len, lines), dtype=np.int64, count=n)
    data = np.frombuffer(b"".join(lines), dtype=np.uint8)
    counts = np.bincount(np.repeat(np.arange(n) * k, lengths) + table[data], minlength=n * k).reshape(n, k)
    own[:, :k] = counts / lengths[:, None]
    seen = set() if seen is None else seen
    for at, line in enumerate(lines):
        words = line.split()
        m = len(words)
        own[at, k:] = (m**-0.5, sum(map(eq, words, words[1:])) / m, 1 - len(set(words)) / m, lengths[at] / m / 16, line in seen, 0)
        seen.add(line)
    own[:, -1] = np.log1p(lengths) / 8
    return own


def features(docs: list[list[bytes]], table: np.ndarray | None = None) -> np.ndarray:
    """A row for each line of each document: its own measures, its neighbours', and which neighbours it has."""
    table = _table() if table is None else table
    n = sum(map(len, docs))
    if not n:
        return np.zeros((0, N_FEATURES))
    own = np.concatenate([own_measures(d, table) for d in docs])
    same = _neighbours(docs)
    before, after = np.zeros_like(own), np.zeros_like(own)
    has_before, has_after = np.zeros(n), np.zeros(n)
    before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
    has_before[1:], has_after[:-1] = same, same
    return np.concatenate([own, before, after, has_before[:, None], has_after[:, None], np.ones((n, 1))], axis=1)


def _neighbours(docs: list[list[bytes]]) -> np.ndarray:
    """Of all lines one after another, which have the next one in the same document."""
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    return doc[1:] == doc[:-1]


@dataclass
class Field:
    """Weights of the good state's features (the bad state's are zero) and log transition scores, bad first."""

    weights: np.ndarray
    transitions: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    prior: float

    def unary(self, docs: list[list[bytes]], table: np.ndarray, block: int = 20_000) -> np.ndarray:
        """Scores of all lines, as ``features`` times the weights.

        A line's measures enter its own score and its neighbours' by a product each, so only three numbers a line are
        kept, whatever a document's length.
        """
        w = self.weights / self.scale
        parts = np.stack([w[:_OWN], w[_OWN : 2 * _OWN], w[2 * _OWN : 3 * _OWN]], axis=1)
        sums = np.zeros((sum(map(len, docs)), 3))
        at = 0
        for d in docs:
            seen: set[bytes] = set()
            for start in range(0, len(d), block):
                own = own_measures(d[start : start + block], table, seen)
                sums[at : at + len(own)] = own @ parts
                at += len(own)
        out = sums[:, 0] + w[-1] - self.center @ w
        same = _neighbours(docs)
        out[1:][same] += sums[:-1, 1][same] + w[-3]
        out[:-1][same] += sums[1:, 2][same] + w[-2]
        return out


def marginals(unary: np.ndarray, mask: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward on padded chains (chains x places): P(good) at each place, and summed pair marginals (2 x 2)."""
    n, t = unary.shape
    score = np.stack([np.zeros_like(unary), unary], axis=2)
    join = lambda a: np.logaddexp(a[..., 0], a[..., 1])
    forward, backward = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    forward[:, 0] = score[:, 0]
    for i in range(1, t):
        step = join((forward[:, i - 1, :, None] + transitions).swapaxes(1, 2)) + score[:, i]
        forward[:, i] = np.where(mask[:, i, None], step, forward[:, i - 1])
    for i in range(t - 2, -1, -1):
        step = join(transitions + (score[:, i + 1] + backward[:, i + 1])[:, None, :])
        backward[:, i] = np.where(mask[:, i + 1, None], step, 0)
    total = join(forward[:, -1])
    good = np.exp(np.minimum(forward[:, :, 1] + backward[:, :, 1] - total[:, None], 0))
    pairs = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            if t > 1:
                p = forward[:, :-1, a] + transitions[a, b] + score[:, 1:, b] + backward[:, 1:, b] - total[:, None]
                pairs[a, b] = (np.exp(np.minimum(p, 0)) * mask[:, 1:]).sum()
    return good, pairs


def alike(counts: np.ndarray) -> list[slice]:
    """Runs of chains, given by their ascending lengths, that take at most about four times their places when padded."""
    out, at = [], 0
    while at < len(counts):
        end, total = at + 1, int(counts[at])
        while end < len(counts) and counts[end] * (end - at + 1) <= 4 * total + 256:
            total += int(counts[end])
            end += 1
        out.append(slice(at, end))
        at = end
    return out


def fit(x: list[np.ndarray], labels: list[int], rounds: int = 150, rate: float = 0.08, penalty: float = 1e-3) -> Field:
    """The field of greatest penalised likelihood of chains ``x`` (lines x features) whose lines all have the label."""
    prior = float(np.mean(labels)) if labels else 0.5
    used = [(f, y) for f, y in zip(x, labels) if len(f)]
    if not used:
        return Field(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(N_FEATURES), np.ones(N_FEATURES), prior)
    flat = np.concatenate([f for f, _ in used])
    center, scale = flat.mean(axis=0), flat.std(axis=0)
    center[-1], scale[scale < 1e-6] = 0.0, 1.0
    n = len(used)
    used.sort(key=lambda u: len(u[0]))
    groups = []
    seen_pairs = np.zeros((2, 2))
    for rows in alike(np.array([len(f) for f, _ in used])):
        part = used[rows]
        t = len(part[-1][0])
        padded, mask = np.zeros((len(part), t, N_FEATURES)), np.zeros((len(part), t), dtype=bool)
        for i, (f, _) in enumerate(part):
            padded[i, : len(f)] = (f - center) / scale
            mask[i, : len(f)] = True
        y = np.array([label for _, label in part], dtype=float)
        links = mask[:, 1:].sum(axis=1)
        seen_pairs[0, 0] += links[y == 0].sum()
        seen_pairs[1, 1] += links[y == 1].sum()
        groups.append((padded, mask, y))
    weights, transitions = np.zeros(N_FEATURES), np.zeros((2, 2))
    moment = [np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, rounds + 1):
        slope_w, pairs = np.zeros(N_FEATURES), np.zeros((2, 2))
        for padded, mask, y in groups:
            good, held = marginals(padded @ weights, mask, transitions)
            slope_w += np.einsum("it,itf->f", np.where(mask, y[:, None] - good, 0), padded)
            pairs += held
        slope_w = slope_w / n - penalty * weights
        slope_t = (seen_pairs - pairs) / n - 20 * penalty * transitions
        for k, (slope, value) in enumerate(((slope_w, weights), (slope_t, transitions))):
            moment[2 * k] += 0.1 * (slope - moment[2 * k])
            moment[2 * k + 1] += 0.01 * (slope**2 - moment[2 * k + 1])
            value += rate * (moment[2 * k] / (1 - 0.9**step)) / (np.sqrt(moment[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return Field(weights, transitions, center, scale, prior)


def score_group(docs: list[list[bytes]], field: Field, table: np.ndarray) -> list[float]:
    """Length-weighted mean of the lines' good marginals; the prior for documents without lines."""
    counts = np.array([len(d) for d in docs])
    out = np.full(len(docs), field.prior)
    some = np.flatnonzero(counts)
    if not len(some):
        return out.tolist()
    unary = field.unary(docs, table)
    weights = np.array([len(line) for d in docs for line in d], dtype=float)
    starts = np.cumsum(counts) - counts
    some = some[np.argsort(counts[some], kind="stable")]  # chains of similar length together
    for part in alike(counts[some]):
        rows = some[part]
        t = int(counts[rows].max())
        place = np.arange(t)
        mask = place < counts[rows][:, None]
        index = np.where(mask, starts[rows][:, None] + place, 0)
        good, _ = marginals(np.where(mask, unary[index], 0), mask, field.transitions)
        w = np.where(mask, weights[index], 0)
        out[rows] = (good * w).sum(axis=1) / w.sum(axis=1)
    return np.clip(out, 0, 1).tolist()


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, max_documents: int, id_col: str, text_col: str):
    """Line features and labels of at most ``max_documents`` labelled documents that are not held out."""
    chosen = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
        .filter("doc_id is not null and quality is not null")
        .filter(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_documents)
    )

    def run(batches):
        table = _table()
        for b in batches:
            data, y = [], []
            for t, label in zip(b.column(0), b.column(1).to_pylist()):
                lines = lines_of((t.as_py() or "").encode("utf-8", "replace"))
                data.append(features([lines], table).astype(np.float32).tobytes())
                y.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), pa.array(y, pa.int32())], names=["x", "y"])

    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("text", "quality", "doc_id")
    sample = sorted(rows.select("text", "quality").mapInArrow(run, "x binary, y int").collect(), key=lambda r: (r["y"], bytes(r["x"])))
    x = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, N_FEATURES).astype(float) for r in sample]
    return x, [int(r["y"] > 0) for r in sample]


def score_quality(
    docs: DataFrame, labels: DataFrame, max_documents: int = 3000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: (doc_id, held_out, score, predicted).

    The field learns from at most ``max_documents`` labelled documents (the least by a hash of their ids), each
    whole, whose crc32 of the id is not 1 modulo 3; every whole text is scored.  Only the text
    enters a score.  Null and empty texts get the share of good documents in the sample; repeated rows get equal
    scores; without labels all scores are 0.5; an empty table gives an empty result; other columns are ignored.
    """
    field = fit(*training_sample(docs, labels, max_documents, id_col, text_col))

    def run(batches):
        table = _table()

        def group(ids, lines):
            s = score_group(lines, field, table)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s, pa.float64())], names=["doc_id", "score"])

        ids, lines, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                data = (t.as_py() or "").encode("utf-8", "replace")
                ids.append(i)
                lines.append(lines_of(data))
                size += len(data)
                if size > 2_000_000:
                    yield group(ids, lines)
                    ids, lines, size = [], [], 0
        if ids:
            yield group(ids, lines)

    scored = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
