"""``corpus_pipeline.run`` against a plain version of every stage, and odd rows through each stage."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tokenizers

import corpus_pipeline as pipeline
from tallymark.llm import oracles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cuts string, live_spans string, kept_id long, live_id string, text_key string, stretches string, part int"
EXTRA = ("c", "l", 5, "i", "k", "s", 7)
PASSAGE = 50
DETECTORS = (
    (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24),
    (r"gh[pousr]_[A-Za-z0-9]+", 0, 40), (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *EXTRA) for i, t, s in rows], SCHEMA)


def made_rows():
    draw = random.Random(21)
    vocabulary = ["".join(draw.choices("abcdefghijk", k=draw.randint(3, 8))) for _ in range(3000)]
    words = lambda n: draw.choices(vocabulary, k=n)
    texts = [words(draw.randint(60, 160)) for _ in range(40)] + [words(5), words(9)]
    for k in range(8):  # near copies
        copy = list(texts[k])
        copy[draw.randrange(len(copy))] = "edited"
        texts.append(copy)
    for n in (50, 58, 70, 120):  # passages in several texts, alone and inside longer ones
        shared = words(n)
        around = words(200), words(190)
        texts += [words(300) + shared + words(310), around[0] + shared + around[1] + words(150), around[0][120:] + shared + around[1][:90] + words(500), words(400) + shared]
    rows = [(7 * k + 3, " ".join(t), f"s{k % 5}") for k, t in enumerate(texts)]
    example = "token=A1b2C3d4E5f6G7h8I9"
    for k in range(0, 12):
        i, t, s = rows[k + 10]
        own = hashlib.sha256(bytes([k])).hexdigest()[:30]
        rows[k + 10] = (i, f"{t} {example if k % 2 else own + ' password: ' + own} end", s)
    return rows


def near_kept(texts):
    sets = {i: set(zip(*[w[j:] for j in range(5)])) if len(w) >= 5 else {tuple(w)} for i, w in ((i, t.lower().split()) for i, t in texts.items())}
    root = {i: i for i in sets}
    for _ in range(10):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {i: t for i, t in texts.items() if root[i] == i}


def without_passages(texts):
    words = {i: re.findall(r"[^\x20\t-\r]+[\x20\t-\r]*", t) for i, t in texts.items()}
    places = collections.defaultdict(list)
    for i in sorted(words):
        plain = [w.rstrip() for w in words[i]]
        for s in range(len(plain) - PASSAGE + 1):
            places[tuple(plain[s : s + PASSAGE])].append((i, s))
    own, earlier = collections.defaultdict(set), collections.defaultdict(list)
    for found in places.values():
        if len(found) > 1:
            first = min(found)
            own[first[0]].update(range(first[1], first[1] + PASSAGE))
            for i, s in found:
                if (i, s) != first:
                    earlier[i].append((s, max(0, first[1] + PASSAGE - s) if i == first[0] else 0))
    out = {}
    for i, t in texts.items():
        cut = {p for s, _ in earlier[i] for p in range(s, s + PASSAGE)} - own[i]
        cut |= {p for s, skip in earlier[i] if not cut & set(range(s, s + PASSAGE)) for p in range(s + skip, s + PASSAGE)}
        left = "".join(w for p, w in enumerate(words[i]) if p not in cut)
        if left.split():
            out[i] = left
    return out


def without_secrets(texts, source):
    found = collections.defaultdict(list)
    owners, repos = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in texts.items():
        for pattern, group, least in DETECTORS:
            for m in re.finditer(pattern, t):
                if len(m[group]) >= least:
                    found[i].append((m.end() - len(m[group]), m.end(), m[group]))
                    owners[m[group]].add(source[i])
                    repos[m[group]].add((source[i], "en"))
    out = {}
    for i, t in texts.items():
        live = [(a, z) for a, z, v in found[i] if len(owners[v]) < 3 and len(repos[v]) < 5 and len(v) >= 16 and re.search("[0-9]", v) and re.search("[A-Za-z]", v)]
        text, at = "", 0
        for a, z in sorted(set(live)):
            text += t[at:a] + "[redacted]" if a >= at else ""
            at = max(at, z)
        out[i] = text + t[at:]
    return out


def test_run_by_plain_versions(spark, tmp_path):
    rows = made_rows()
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    accepted = {r[0] for r in db.execute(f"SELECT doc_id FROM ({oracles.quality_rules()}) WHERE kept").fetchall()}
    texts = {i: t for i, t, _ in rows if i in accepted}
    steps = [texts, near_kept(texts)]
    steps.append(without_passages(steps[-1]))
    steps.append(without_secrets(steps[-1], {i: s for i, _, s in rows}))
    assert len(rows) > len(steps[0]) > len(steps[1]) and steps[1] != steps[2] != steps[3] and "[redacted]" in "".join(steps[3].values())

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, text in steps[-1].items():
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
        starts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048)]
        want |= {(i, k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(ids)]))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    used = collections.defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(places), sorted(places)[1:])) and sum(n for _, n in places) <= 2048


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_odd_rows_through_each_stage(spark, name, tmp_path):
    stage = dict(pipeline.STAGES)[name]
    draw = random.Random(3)
    prose = lambda n, seed: " ".join(random.Random(seed).choices([f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(500)], k=n))
    key = f"token={hashlib.sha256(b'x').hexdigest()[:20]}G"
    rows = [(1, prose(80, 1), "s"), (1, prose(80, 1), "s"), (2, prose(80, 1), "s"), (None, prose(80, 2), "s"), (None, prose(80, 3) + " " + key, "s"), (None, None, "s"), (None, "", "s"), (3, None, "s"), (4, "", "s"), (5, " ", "s"), (6, prose(30_000, 6), "s"), (7, prose(70, 7) + " " + key, None), (7, prose(75, 8) + " " + key, None)]
    draw.shuffle(rows)
    out = stage(spark, table(spark, rows), str(tmp_path))
    got = out.collect()
    empty = stage(spark, table(spark, []), str(tmp_path))
    assert empty.columns == out.columns and empty.count() == 0
    if name == "best-fit packing":
        assert collections.Counter(r.doc_id for r in got if r.piece == 0) == collections.Counter(i for i, _, _ in rows)
        return
    assert out.columns == table(spark, []).columns and all((r.cuts, r.live_spans, r.kept_id, r.live_id, r.text_key, r.stretches, r.part) == EXTRA for r in got)
    ids = collections.Counter(r.doc_id for r in got)
    everything = collections.Counter(i for i, _, _ in rows)
    if name == "quality rules":
        assert set(ids) == {1, 2, None, 6, 7} and ids[None] == 2
    elif name == "MinHash near-dedup":
        assert ids == everything - collections.Counter([2])
    elif name == "suffix-array dedup":
        assert ids == everything - collections.Counter([2]) and {r.text for r in got if r.doc_id == 1} == {prose(80, 1)}
    else:
        texts = [r.text for r in got if r.text]
        assert ids == everything and not any(key in t for t in texts) and sum("token=[redacted]" in t for t in texts) == 3
