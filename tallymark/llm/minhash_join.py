"""Near-duplicate classes by an inverted join on signature coordinates.

Rows with equal shingle sets are one node.  A node posts itself under each (coordinate, value) of its MinHash
signature.  Two nodes are candidates if they collide in at least ``min_matches`` coordinates:

* a value that one node alone holds can't collide, so nodes with too few shared values leave at once (skip);
* ordered from the rarest value on, two candidates share one of the first ``n - min_matches + 1`` (prefix), so only
  those are merged; values that very many nodes hold come last and mostly fall outside the prefix.

Candidates are confirmed on full sets.  To find classes it is not needed to list all pairs of a posting: its members
are first compared with one leader, twice, so a posting of many copies of one text costs as many comparisons as it has
members.  Members that still lie in different classes mostly share a passage and little else.  They are not paired by
the posting: among them, the shingles of each are ordered from the rarest on, two that link share one of the first
``n - percent * n + 1``, and where in the order they share it bounds what they can have in common.  That is an exact
prefix and position filter, so no link between candidates is lost.  Shared passages, being frequent, come last, and a
member with enough shingles of its own is through at once.

A bitmap filter spares looking at sets: a node holds one parity bit for each of 512 buckets of its shingles.  Where two
bits differ, at least one shingle of that bucket is in one set alone, so the bits that differ can't outnumber the
shingles not shared; more of them than a link allows rule it out for certain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, stored, text_key
from .components import components
from .shingles import WordHashes, mixed, shingle_set

_SIGNED = "doc_id long, n_shingles long, hi long, lo long, signature array<int>, parity array<long>, text_key string"
_PARITY_WORDS = 8


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    data = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), dtype="<i8")
    return int(data[0]), int(data[1])


def _sets(batches, shingle: int, group_chars: int = 2_000_000, label=lambda b: b.column(0).to_pylist()):
    """Groups of (ids or other labels, shingle sets) of a few megabytes of text, or one longer text."""
    hashes = WordHashes()
    ids, sets, size = [], [], 0
    for b in batches:
        for i, t in zip(label(b), b.column(1)):
            data = (t.as_py() or "").encode("utf-8", "replace").lower()
            ids.append(i)
            sets.append(shingle_set(hashes(data.split()), shingle))
            size += len(data)
            if size > group_chars:
                yield ids, sets
                ids, sets, size = [], [], 0
    if ids:
        yield ids, sets


def _parity(shingles: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each set (they lie one after another) whether each bucket holds an odd number of its shingles, packed."""
    buckets = 64 * _PARITY_WORDS
    bucket = (mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(lengths)) * buckets, lengths) + bucket, minlength=len(lengths) * buckets)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64).reshape(len(lengths), _PARITY_WORDS)


def _may_link(percent: int):
    """False only for nodes a and b that can't link, by the bitmap filter."""
    differ = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(_PARITY_WORDS)), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b"))


def signatures(docs: DataFrame, shingle: int, coordinates: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, signature, parity bits, text key) of each row.

    An empty set has neither signature nor parity bits, a row with an id has no text key.
    """

    def run(batches):
        draw = np.random.default_rng(20_081)
        a = draw.integers(0, 2**63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        c = draw.integers(0, 2**63, coordinates, dtype=np.uint64)
        for labels, sets in _sets(batches, shingle, label=lambda b: list(zip(b.column(0).to_pylist(), b.column(2).to_pylist()))):
            ids, keys = zip(*labels)
            lengths = np.array([len(s) for s in sets])
            some = np.flatnonzero(lengths)
            signed = np.zeros((len(some), coordinates), dtype=np.uint32)
            parity = np.zeros((len(some), _PARITY_WORDS), dtype=np.int64)
            if len(some):
                every = np.concatenate([sets[i] for i in some])
                starts = np.cumsum(lengths[some]) - lengths[some]
                for j in range(coordinates):
                    signed[:, j] = np.minimum.reduceat((every * a[j] + c[j]) >> np.uint64(32), starts)
                parity = _parity(every, lengths[some])
            digests = [_digest(s) if len(s) else (None, None) for s in sets]
            offsets = np.zeros(len(sets) + 1, dtype=np.int32)
            offsets[1:] = np.cumsum(lengths > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets * np.int32(coordinates)), pa.array(signed.reshape(-1).view(np.int32))),
                    pa.ListArray.from_arrays(pa.array(offsets * np.int32(_PARITY_WORDS)), pa.array(parity.reshape(-1))),
                    pa.array(keys, pa.string()),
                ],
                names=["doc_id", "n_shingles", "hi", "lo", "signature", "parity", "text_key"],
            )

    texts = id_and_text(docs, id_col, text_col).withColumn("text_key", F.when(F.col("doc_id").isNull(), text_key(F.col("text"))))
    return texts.mapInArrow(run, _SIGNED)


def _full_sets(docs: DataFrame, nodes: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the nodes, read again from their texts."""

    def run(batches):
        for ids, sets in _sets(batches, shingle):
            digests = [_digest(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["node", "hi", "lo", "shingles"],
            )

    texts = id_and_text(docs, id_col, text_col).join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    sets = texts.mapInArrow(run, "node long, hi long, lo long, shingles array<long>")
    return sets.join(nodes, ["node", "hi", "lo"], "left_semi").dropDuplicates(["node"]).select("node", "shingles")


class _Links:
    """Confirms candidate pairs, keeping what it has confirmed so far."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, percent: int, min_matches: int):
        self._nodes, self._sets = nodes, sets
        self._percent, self._min_matches = percent, min_matches

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose signatures match often enough and whose full sets are similar."""
        side = lambda df, name, *values: df.select(F.col("node").alias(name), *[F.col(v).alias(f"{v}_{name}") for v in values])
        near = (
            pairs.join(side(self._nodes, "a", "posted", "parity", "n"), "a")
            .join(side(self._nodes, "b", "posted", "parity", "n"), "b")
            .filter(_may_link(self._percent) & (F.size(F.array_intersect("posted_a", "posted_b")) >= self._min_matches))
            .select("a", "b")
        )
        both = near.join(side(self._sets, "a", "shingles"), "a").join(side(self._sets, "b", "shingles"), "b")
        common = F.size(F.array_intersect("shingles_a", "shingles_b"))
        union = F.size("shingles_a") + F.size("shingles_b") - F.col("common")
        return both.withColumn("common", common).filter(100 * F.col("common") >= self._percent * union).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    coordinates: int = 32,
    min_matches: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keyed: bool = False,
) -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id, kept), and the text key of rows without an id if ``keyed``.

    Words are runs of characters other than ASCII white space, with A-Z lowered.  Rows link if
    ``100 * intersection >= percent * union`` of their sets of distinct shingles.  ``min_matches`` defaults to five
    standard deviations below the matches expected at the limit, so that a link is missed about once in a million.
    Pairs are retained above that number of matches, then confirmed exactly.

    Rows without words link with nothing.  Rows with one doc_id count as one document, and each is kept or not like
    it; rows without a doc_id get the component of equal texts, if any has an id, and are kept only if none has.
    An empty table gives an empty result; other columns are ignored.
    """
    p = percent / 100
    if min_matches is None:
        min_matches = max(1, int(coordinates * p - 5 * (coordinates * p * (1 - p)) ** 0.5))
    signed = stored(signatures(docs, shingle, coordinates, id_col, text_col), "signatures")
    sized = signed.filter("n_shingles > 0")
    classes = stored(sized.groupBy("hi", "lo").agg(F.min("doc_id").alias("node")), "set-classes")

    first = classes.filter("node is not null").withColumnRenamed("node", "doc_id")
    nodes = stored(sized.join(first, ["hi", "lo", "doc_id"], "left_semi").dropDuplicates(["hi", "lo"]), "nodes")
    posting = F.posexplode("signature").alias("coordinate", "value")
    code = (F.shiftleft(F.col("coordinate").cast("long"), 32)).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    nodes = nodes.withColumnRenamed("doc_id", "node")
    posts = nodes.select("node", posting).select("node", code.alias("code"))
    # what is counted is written before it meets what it was counted from: such a join can be split at a hot value
    shared = stored(posts.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared-codes")
    able = (
        posts.join(shared, "code")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("n", "code"))).alias("held"))  # at most one for each coordinate
        .filter(F.size("held") >= min_matches)
        .join(nodes.select("node", "hi", "lo", "n_shingles", "parity"), "node")
        .select("node", "hi", "lo", "n_shingles", "parity", F.col("held.code").alias("posted"))
    )
    able = stored(able, "able-nodes")
    prefix = F.slice("posted", F.lit(1), F.size("posted") - (min_matches - 1))
    posts = able.select("node", "n_shingles", F.explode(prefix).alias("code"))
    merged = stored(posts.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("code"), "merged-codes")
    posts = stored(posts.join(merged, "code"), "prefix-postings")
    # min over max of two linked sets' sizes is at least the limit
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")

    members = posts.select("node").distinct()
    sets = stored(_full_sets(docs, able.join(members, "node", "left_semi").select("node", "hi", "lo"), shingle, id_col, text_col), "full-sets")
    links = _Links(able.select("node", "posted", "parity", F.col("n_shingles").alias("n")), sets, percent, min_matches)

    leader = posts.groupBy("code").agg(F.min(F.struct(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"))).alias("l")).select("code", "l.*")
    leader = stored(leader, "leaders")
    pairs = posts.withColumnsRenamed({"node": "b", "n_shingles": "n_b"}).join(leader, "code").filter("a <> b").filter(fits).select("a", "b").distinct()
    edges = stored(links.confirmed(pairs), "edges")
    grouped = _grouped(posts, edges)

    # the least node outside the first leader's class leads the rest
    led = grouped.join(leader, "code").join(grouped.select(F.col("node").alias("a"), F.col("component").alias("c_a")).distinct(), "a")
    second = led.filter("component <> c_a").groupBy("code").agg(F.min(F.struct(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("component").alias("c_a"))).alias("l")).select("code", "l.*")
    second = stored(second, "leaders")
    pairs = grouped.withColumnsRenamed({"node": "b", "n_shingles": "n_b"}).join(second, "code").filter("component <> c_a").filter(fits)
    more = stored(links.confirmed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), "edges")
    edges = edges.unionByName(more)
    grouped = _grouped(posts, edges)

    apart = grouped.groupBy("code").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("code")
    rest = stored(grouped.join(stored(apart, "apart-codes"), "code").select("node", "component").distinct(), "apart")
    apart_sets = stored(sets.join(rest.join(able.select("node", "parity"), "node"), "node"), "apart-sets")
    pairs = _sharing_rare(apart_sets, percent).distinct()
    edges = edges.unionByName(stored(links.confirmed(pairs), "edges"))

    found = components(edges)
    by_set = classes.join(found, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("component"))
    joined = sized.join(by_set, ["hi", "lo"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "text_key")
    empty = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key")
    kept = F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return joined.unionByName(empty).select("doc_id", "n_shingles", "component_id", kept.alias("kept"), *(["text_key"] if keyed else []))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that ``near_duplicates`` keeps, with all columns; rows without an id are told apart by their texts."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, keyed=True, **options).filter("kept")
    found = found.select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")).distinct()
    own_id = docs[id_col].cast("long")
    own_key = F.when(own_id.isNull(), text_key(docs[text_col]))
    return docs.join(found, own_id.eqNullSafe(found["kept_id"]) & own_key.eqNullSafe(found["kept_key"]), "left_semi").select(*docs.columns)


def _sharing_rare(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of nodes of different classes that may link, from (node, shingles, component, parity); a pair may stand repeatedly."""
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    shared = stored(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("held_by")).filter("held_by > 1"), "shared-shingles")
    ordered = each.join(shared, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held_by", "shingle"))).alias("held"))  # of one set
    size, held = F.size("shingles"), F.size("held")
    prefix = size - F.ceil(size * percent / F.lit(100)).cast("int") + 1
    firsts = ordered.join(sets, "node").select(
        "node", "component", "parity", size.alias("n"), (size - held).alias("own"), F.slice("held", F.lit(1), F.greatest(prefix - (size - held), F.lit(0))).alias("held")
    )
    posts = firsts.select("node", "component", "parity", "n", "own", F.posexplode("held").alias("at", "h"))
    posts = stored(posts.select("node", "component", "parity", "n", (F.col("own") + F.col("at") + 1).alias("place"), "h.shingle"), "rare-postings")
    side = lambda x: posts.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "parity", "n", "place")])
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    most = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    near = fits & ((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))) & _may_link(percent)
    met = side("a").join(side("b"), "shingle").filter("node_a < node_b and component_a <> component_b").filter(near)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _grouped(posts: DataFrame, edges: DataFrame) -> DataFrame:
    """The postings with each node's class so far."""
    found = components(edges)
    return stored(
        posts.join(found, "node", "left").select("code", "node", "n_shingles", F.coalesce("component", "node").alias("component")), "grouped"
    )
