"""Each operator against a brute-force version and odd rows: nulls, empty and long texts, ties, repeats, no rows."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from tallymark.llm import bpe_lexicon, crf_quality, flac, license_scan, minhash_join, packing, quality_rules, secret_scan, suffix_dedup, token_counts, transducer
from tallymark.llm.components import components

WORD, PIECE, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hi string, n string, score string"
ODD = ["", " ", "a", "a ", "  a  b", "\n\n x\x0by", "ﬁ İ ΑΣ. 日本語 ①²", "x\x1cy", "<|endoftext|>x <|startoftext|>", "😀👍🏽 café’s — ▁a", "é" * 300 + "abc" * 100]


def made(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k % 4}", None, "x", None, "y") for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(900)]
    text = lambda n: " ".join(draw.choices(vocabulary, k=n))
    out = [(i, text(draw.randint(1, 220))) for i in range(60)]
    shared = text(70)
    for i in range(60, 80):
        base = out[draw.randrange(60)][1].split(" ")
        if i % 3 == 0:
            base[draw.randrange(len(base))] = "edit"
        out.append((i, " ".join(base) if i % 2 else text(30) + " " + shared + " " + text(20)))
    out += [(100 + k, t) for k, t in enumerate(ODD)] + [(200, None), (None, None), (None, out[1][1]), (201, text(30_000)), (3, out[3][1]), (3, out[3][1])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return made(spark, rows).cache()


def test_bpe(spark, docs, rows):
    t = tokenizers.Tokenizer.from_file(WORD)
    want = collections.Counter()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))] += 1
    got = collections.Counter(map(tuple, bpe_lexicon.encode_digests(docs, WORD, 200).collect()))
    assert got == want
    assert bpe_lexicon.encode_digests(made(spark, []), WORD).count() == 0
    one = bpe_lexicon.encode(made(spark, [(1, "Hello hello")]), WORD).first()
    assert one.ids == t.encode("Hello hello", add_special_tokens=False).ids


def test_bpe_memo_smaller_than_a_text():
    t = tokenizers.Tokenizer.from_file(WORD)
    encoder = bpe_lexicon.Encoder(WORD, bpe_lexicon.lexicon(["one", "two"], WORD), memo_words=4)
    for text in ("one two red", "one two blue green grey pink teal gold", "gold one", "", "two red plum"):
        ids = t.encode(text, add_special_tokens=False).ids
        assert encoder.encode_many([text, text]) == [ids] * 2
        assert encoder.written_many([text]) == [(len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))]


def test_transducer():
    words = sorted({w.encode() for w in "a ab abc b bc tap taps top tops stop stops é".split()})
    t = transducer.Transducer.mapped(transducer.compile_words({w: [i, i + 1] for i, w in enumerate(words)}))
    assert t.ranks(words).tolist() == list(range(len(words))) and t.ids(3) == (3, 4)
    assert t.ranks([b"", b"ta", b"tapss", b"z"]).tolist() == [-1] * 4
    assert transducer.Transducer(transducer.compile_words({})).ranks([b"a", b""]).tolist() == [-1, -1]


def test_merges_long_as_short():
    m = bpe_lexicon.Merges(bpe_lexicon.token_words.load(WORD)[1])
    draw = random.Random(1)
    for _ in range(200):
        letters = draw.choices("abcdehinorst", k=draw.randint(2, 40))
        letters[-1] += "</w>"
        assert m._short(list(letters)) == m._long(list(letters))


def test_repeated_passages(spark, docs, rows):
    texts = {i: (t or "").split() for i, t in rows if i is not None}
    size, places = 50, collections.defaultdict(list)
    for k, (i, t) in enumerate(rows):
        w = (t or "").encode().split()
        for s in range(len(w) - size + 1) if i is not None else ():
            places[b" ".join(w[s : s + size])].append((i, s))
    covered, cut, own = (collections.defaultdict(set) for _ in range(3))
    for found in places.values():
        if len(found) > 1:
            for p in found:
                covered[p[0]].update(range(p[1], p[1] + size))
                (own if p == min(found) else cut)[p[0]].update(range(p[1], p[1] + size))
    want = {i: (len(c), len(cut[i] - own[i])) for i, c in covered.items()}
    got = suffix_dedup.repeated_passages(docs).collect()
    assert {r.doc_id: (r.n_repeat_words, r.n_cut_words) for r in got} == want and len(want) > 5
    assert all(r.repeats[-1].end <= len(texts[r.doc_id]) for r in got)
    assert suffix_dedup.repeated_passages(made(spark, [])).count() == 0
    assert suffix_dedup.cut_words("a b  c d\ne", [(1, 3)]) == "a d\ne"
    left = {r.doc_id: r.text for r in suffix_dedup.without_cuts(docs, suffix_dedup.repeated_passages(docs), docs.columns).filter("doc_id is not null").collect()}
    again = collections.Counter(" ".join(w[s : s + size]) for w in [t.split() for t in left.values() if t] for s in range(len(w) - size + 1))
    assert not again or max(again.values()) == 1


def test_passage_inside_a_longer_repeat(spark):
    draw = random.Random(8)
    text = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    left, right = text(60), text(70)
    for n in (50, 60, 98, 99, 200):
        inner = text(n)
        whole = " ".join(left + inner + right)
        docs = made(spark, [(1, " ".join(text(20) + inner + text(5))), (2, whole), (3, whole), (4, " ".join(text(30) + inner))])
        found = suffix_dedup.repeated_passages(docs).cache()
        cuts = {r.doc_id: [(c.start, c.end) for c in r.cuts] for r in found.collect()}
        own = 49 if n > 98 else 0  # those of the stretch's first windows that can stay
        assert cuts == {1: [], 2: [(60 + own, 60 + n - own)], 3: [(0, 130 + n)], 4: [(30, 30 + n)]}
        texts = {r.doc_id: r.text for r in suffix_dedup.without_cuts(docs, found, docs.columns).collect()}
        windows = collections.Counter(tuple(w[s : s + 50]) for w in map(str.split, texts.values()) for s in range(len(w) - 49))
        assert 3 not in texts and max(windows.values()) == 1


def test_suffixes_in_small_groups(spark, docs):
    """Beginnings that outgrow the memory meant for a group, or a task, give the same spans."""
    draw = random.Random(9)
    words = [f"v{k}" for k in range(400)]
    shared = draw.choices(words, k=60)
    texts = [(1000 + k, " ".join(draw.choices(words, k=k % 5 * 9) + shared[k % 3 * 4 : 60 - k % 4] + draw.choices(words, k=k % 7 * 8))) for k in range(60)]
    table = docs.unionByName(made(spark, texts))
    rows = lambda **k: sorted(map(tuple, suffix_dedup.repeated_passages(table, **k).collect()), key=lambda r: r[0])
    want = rows()
    assert len(want) > 60 and rows(group_rows=1) == want == rows(group_rows=7)
    windows = collections.Counter(tuple(w[s : s + 50]) for _, t in texts for w in [t.split()] for s in range(len(w) - 49))
    for i, t in texts:
        w = t.split()
        covered = {s + j for s in range(len(w) - 49) if windows[tuple(w[s : s + 50])] > 1 for j in range(50)}
        assert sum(r[1] for r in want if r[0] == i) == len(covered)


def test_passage_over_its_own_first_place(spark):
    """A run of short period keeps the first place of each of its windows, where no earlier document holds them."""
    period = [f"p{k}" for k in range(7)]
    rows = [(1, " ".join(["a"] * 120)), (2, " ".join(["a"] * 90)), (3, " ".join(period * 30))]
    got = {r.doc_id: [(c.start, c.end) for c in r.cuts] for r in suffix_dedup.repeated_passages(made(spark, rows)).collect()}
    assert got == {1: [(50, 120)], 2: [(0, 90)], 3: [(56, 210)]}


def test_near_duplicates(spark, docs, rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(root)
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    got = minhash_join.near_duplicates(docs, shingle=3, percent=85).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)
    assert sorted((r.component_id is None, r.kept) for r in got if r.doc_id is None) == [(False, False), (True, True)]
    assert minhash_join.near_duplicates(made(spark, [])).count() == 0


def test_chained_links(spark):
    """Members of one posting that link only through each other, and not with its least member."""
    base = [f"w{i}" for i in range(400)]
    texts = [(k, " ".join(base[: 400 - 12 * k] + [f"x{j}" for j in range(12 * k)])) for k in range(12)]
    got = {r.doc_id: r.component_id for r in minhash_join.near_duplicates(made(spark, texts), shingle=3, percent=85).collect()}
    sets = {i: set(zip(t.split(), t.split()[1:], t.split()[2:])) for i, t in texts}
    assert 100 * len(sets[0] & sets[11]) < 85 * len(sets[0] | sets[11]) and set(got.values()) == {0}


def test_recall_at_the_limit(spark):
    """Pairs right at the limit: at least 85 of 100 shingles in common, at most 87."""
    draw = random.Random(12)
    rows, linked = [], []
    for k in range(500):
        words = [f"p{k}w{draw.randrange(10**6)}" for _ in range(draw.randint(120, 400))]
        other = list(words)
        shingles = lambda w: set(zip(w, w[1:], w[2:]))
        share = lambda a, b: 100 * len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        while True:
            before = list(other)
            other[draw.randrange(len(other))] = f"e{draw.randrange(10**9)}"
            if share(words, other) < 85:
                break
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(before)), (10 * k + 2, " ".join(other))]
        if share(words, before) <= 87:
            linked.append(k)
        assert share(words, before) >= 85
    got = {r.doc_id: r.component_id for r in minhash_join.near_duplicates(made(spark, rows), shingle=3, percent=85).collect()}
    assert len(linked) > 400
    assert sum(got[10 * k + 1] == 10 * k for k in linked) >= 0.99 * len(linked)


def test_members_of_hot_postings(spark):
    """Texts of one long shared passage and parts of their own: few link, by brute force, and no pairs of all are made."""
    draw = random.Random(2)
    shared = [f"c{k}" for k in range(120)]
    texts = []
    for k in range(150):
        own = [f"o{draw.randrange(10**6)}" for _ in range(draw.randint(10, 40))]
        texts.append(shared[: draw.randint(90, 120)] + own)
        if k % 10 == 0:
            texts.append(texts[-1][:-3] + ["x", "y"])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [set(zip(t, t[1:], t[2:])) for t in texts]
    root = list(range(len(sets)))
    for _ in range(20):
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: r.component_id for r in minhash_join.near_duplicates(made(spark, rows), shingle=3, percent=85).collect()}
    assert got == dict(enumerate(root)) and 20 < len(set(root)) < len(root)


def test_parity_never_rules_out_a_link():
    draw = np.random.default_rng(4)
    for size in (1, 30, 150, 4000):
        base = np.unique(draw.integers(0, 2**63, size, dtype=np.uint64))
        for edits in (0, 1, size // 20, size // 12, size // 3):
            other = np.unique(np.concatenate([base[edits:], draw.integers(0, 2**63, edits, dtype=np.uint64)]))
            bits = minhash_join._parity(np.concatenate([base, other]), np.array([len(base), len(other)]))
            differ = sum(int(x).bit_count() for x in (bits[0] ^ bits[1]).view(np.uint64))
            apart = len(np.setxor1d(base, other))
            assert differ <= apart and (size == 4000 or differ >= apart * 0.6)
    assert minhash_join._parity(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)).shape == (0, 8)


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(50, 49), (49, 48), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and {got[i] for i in (48, 49, 50)} == {48} and len(got) == 34


def test_license(spark):
    rows = [(1, "x\nAll rights reserved. All Rights Reserved\nCC BY cc by"), (2, "Licensed under the Apache License, Version 2.0."), (3, "rights all reserved"), (4, None), (5, ""), (5, "license"), (None, "Released\nunder the MIT License.")]
    got = license_scan.license_scan(made(spark, rows)).orderBy("doc_id", "n_words").collect()
    assert tuple(got[0])[1:] == (5, 0, None, None, "", "mit", 1.0)
    assert tuple(got[1])[:6] == (1, 11, 4, 1, 9, "cc-by,reserved") and got[1].score == 1.0 and "proprietary" in got[1].labels
    assert got[2].labels == "apache-2.0" and got[2].score == 1.0 and got[2].n_base == 0
    assert got[3].labels == "proprietary" and got[3].base_labels == "" and got[4].n_words == 0 == got[5].n_words
    assert license_scan.license_scan(made(spark, [])).count() == 0


def test_license_over_lines(spark):
    """Notices wrapped at any place, at any distance from the text's begin, and blocks against templates by brute force."""
    draw = random.Random(7)
    other = [f"w{k}" for k in range(50)]
    rows = []
    for k, (label, text) in enumerate(sorted(license_scan.TEMPLATES.items())):
        words = text.split()
        for shift in (0, 20, 31, 32, 33, 63, 200):
            wrapped = "".join(w + ("\n" if draw.random() < 0.4 else "\n * " if draw.random() < 0.2 else " ") for w in words)
            rows.append((1000 * k + shift, " ".join(draw.choices(other, k=shift)) + "\n" + wrapped.upper() + " ".join(draw.choices(other, k=40))))
        rows.append((1000 * k + 999, " ".join(draw.sample(words, len(words) * 3 // 4) + draw.choices(other, k=90))))
    got = {r.doc_id: r for r in license_scan.license_scan(made(spark, rows)).collect()}
    for k, label in enumerate(sorted(license_scan.TEMPLATES)):
        assert all(label in got[1000 * k + s].labels.split(",") and got[1000 * k + s].score == 1.0 for s in (0, 20, 31, 32, 33, 63, 200))
    for i, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        blocks = [set(words[b * 32 : b * 32 + 64]) for b in range(max(1, -(-len(words) // 32) - 1))]
        held = {n: max(len(b & set(t.split())) / len(set(t.split())) for b in blocks) for n, t in license_scan.TEMPLATES.items()}
        want = {n for n, share in held.items() if share >= 0.8 - 1e-9}
        base = {x for x in got[i].base_labels.split(",") if x}
        assert set(got[i].labels.split(",")) - {""} == want | base and got[i].score == max([held[n] for n in want], default=0)
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee"
    odd = [(1, bsd), (2, isc), (2, isc), (None, isc), (3, "x " * 60_000 + bsd), (4, None), (5, "released")]
    labels = collections.Counter((r.doc_id, r.labels) for r in license_scan.license_scan(made(spark, odd)).collect())
    assert labels == {(1, "bsd"): 1, (2, "isc"): 2, (None, "isc"): 1, (3, "bsd"): 1, (4, ""): 1, (5, ""): 1}
    assert license_scan.license_scan(made(spark, odd), templates={}).filter("labels <> ''").count() == 0


def test_quality(spark, docs, rows):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(rows)
    for r in [r for r in got if r.doc_id == 201]:
        assert r.n_words == 30_000 and not r.base_failed
    assert quality_rules.repeated_words(b"a b c d e x a b c d e".split()) == 10 and quality_rules.repeated_words([b"a"] * 7) == 7
    kept = collections.Counter(r.doc_id for r in got if r.kept)
    accepted = quality_rules.accepted(docs)
    assert accepted.columns == docs.columns and collections.Counter(r.doc_id for r in accepted.collect()) == kept
    assert quality_rules.quality_rules(made(spark, [])).count() == 0 == quality_rules.accepted(made(spark, [])).count()
    assert quality_rules.js_distance(np.array([[1.0, 0], [0, 0]]), np.array([0.0, 1])).tolist() == [1.0, 0.0]


def test_quality_of_many_languages(spark):
    prose = lambda k: " ".join(f"river{chr(97 + k % 26)} the{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    digits = " ".join(str(10**7 + 7919 * i) for i in range(80))
    rows = [(k, prose(k), f"l{k:03}", "s") for k in range(513)] + [(900, digits, "zz", "s")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[900].nearest_lang == "zz" and got[900].kept and got[900].char_distance == 0 == got[900].word_distance


def test_counts(spark, docs, rows, tmp_path):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = collections.Counter((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows)
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, PIECE, cache).collect())
        assert got == want
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})  # each content was encoded once
    assert token_counts.token_counts(made(spark, []), PIECE).count() == 0


def test_flac(spark, docs, rows):
    got = collections.Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in flac.round_trip(docs).collect())
    want = collections.Counter()
    for i, t in rows:
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        want[i, len(data), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    assert got == want
    blocks = flac.decode(flac.encode(made(spark, [(1, "ab" * 5000)]))).orderBy("first_sample").collect()
    assert b"".join(bytes(b.pcm) for b in blocks)[:10_000] == b"ab" * 5000 and [b.first_sample for b in blocks] == [0, 4608, 9216]
    draw = np.random.default_rng(0)
    tones = (128 + 90 * np.sin(np.arange(576 * 4) / 9)).astype(np.uint8).tobytes()
    for payload in (bytes(576), draw.integers(0, 256, 5760, dtype=np.uint8).tobytes(), tones, bytes(range(256)) * 9):
        stream = flac.write_streams([payload])[0]
        assert flac.read_streams([stream]) == [payload] and flac.read_range(stream, 570, 20) == payload[570:590]
        for at in (-3, -6):
            broken = bytearray(stream)
            broken[at] ^= 4
            with pytest.raises(ValueError):
                flac.read_streams([bytes(broken)])
    assert flac.round_trip(made(spark, [])).count() == 0


def decoded_flac(stream):
    """The samples of a stream by the format's description alone, a bit at a time; no seek table, no checksums."""
    assert stream[:4] == b"fLaC"
    at, last = 4, False
    while not last:
        last, kind, n = stream[at] & 0x80, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            info = int.from_bytes(stream[at + 4 : at + 38], "big")
            total, width = info >> 128 & (1 << 36) - 1, (info >> 164 & 31) + 1
        at += 4 + n
    bits = "".join(f"{b:08b}" for b in stream[at:])
    place = 0

    def take(n):
        nonlocal place
        place += n
        return int(bits[place - n : place], 2) if n else 0

    def signed(n):
        v = take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    out = []
    while len(out) < total:
        assert take(14) == 0b11111111111110
        take(2)
        size_code, rate_code = take(4), take(4)
        take(8)
        lead = take(8)
        for _ in range(max(0, f"{lead:08b}".index("0") - 1)):
            take(8)
        size = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608}[size_code]
        assert rate_code == 4
        take(8)
        kind = take(8) >> 1
        if kind == 0:
            x = [signed(width)] * size
        elif kind == 1:
            x = [signed(width) for _ in range(size)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [signed(width) for _ in range(order)]
            if kind < 32:
                coefficients, shift = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])[order], 0
            else:
                precision, shift = take(4) + 1, signed(5)
                coefficients = [signed(precision) for _ in range(order)]
            method, parts = take(2), take(4)
            for p in range(1 << parts):
                k = take(4 + method)
                assert k < (15, 31)[method]
                for _ in range((size >> parts) - (order if p == 0 else 0)):
                    q = 0
                    while take(1) == 0:
                        q += 1
                    u = q << k | take(k)
                    x.append((u >> 1 ^ -(u & 1)) + (sum(c * x[-1 - j] for j, c in enumerate(coefficients)) >> shift))
        out += x
        place += -place % 8 + 16
    return out[:total]


def test_flac_by_another_decoder(spark):
    draw = random.Random(1)
    texts = ["", "a" * 700, "the town " * 90, "".join(draw.choices("abc déf\n", k=4000)), "".join(map(chr, draw.choices(range(0x4E00, 0x9FFF), k=600)))]
    rows = [(k, t) for k, t in enumerate(texts)]
    media = {r.doc_id: bytes(r.media) for r in flac.encode(made(spark, rows)).collect()}
    shown = {r.doc_id: r for r in flac.round_trip(made(spark, rows)).collect()}
    for k, t in rows:
        payload = t.encode() + b"\xff" * (-len(t.encode()) % 576 or (0 if t else 576))
        x = decoded_flac(media[k])
        assert bytes(v + 128 for v in x) == payload
        assert (shown[k].media_bytes, shown[k].media_sha256) == (len(media[k]), hashlib.sha256(media[k]).hexdigest())
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:]))
        assert shown[k].feature == f"mean={sum(x) // len(x)};energy={sum(v * v for v in x) // len(x)};peak={max(map(abs, x))};crossings={crossings}"


def test_flac_in_groups_of_frames():
    draw = random.Random(2)
    payloads = [bytes(draw.choices(range(40, 120), k=576 * n)) for n in (1, 5, 140, 2)]
    streams = flac.write_streams(payloads)
    for group in (1, 3, 7, 1000):
        assert flac.write_streams(payloads, group) == streams and flac.read_streams(streams, group) == payloads
    with pytest.raises(ValueError):
        flac.write_streams([bytes(576 * 932_100)])


def best_two_fit(lengths, capacity):
    """The same rule one document at a time over a plain list: fill greedily, then swap the smallest for the best two."""
    left, bins = sorted(lengths), []
    while left:
        taken, gap = [left.pop()], capacity
        gap -= taken[0]
        while fits := [x for x in left if x <= gap]:
            taken.append(fits[-1])
            left.remove(fits[-1])
            gap -= fits[-1]
        while gap and len(taken) > 1:
            small = min(taken)
            sums = [left[i] + left[j] for i in range(len(left)) for j in range(i) if left[i] + left[j] <= gap + small]
            best = max(sums, default=0)
            if best <= small:
                break
            x = min(left[j] for i in range(len(left)) for j in range(i) if left[i] + left[j] == best)
            taken.remove(small)
            for item in (x, best - x):
                left.remove(item)
                taken.append(item)
            left = sorted([*left, small])
            gap += small - best
        bins.append(sorted(taken))
    return sorted(bins)


def test_best_two_fit_by_single_documents():
    draw = random.Random(3)
    for n in (0, 1, 5, 30, 60):
        lengths = draw.sample(range(1, 101), n)  # distinct lengths: every planned bin stands once
        got = [sorted(taken) for taken, times in packing.plan(dict.fromkeys(lengths, 1), 100) for _ in range(times)]
        assert sorted(got) == best_two_fit(lengths, 100)
    with pytest.raises(ValueError):
        packing.plan({101: 1}, 100)


def test_ranked_ids_as_the_library():
    t = tokenizers.Tokenizer.from_file(BYTE)
    ids_of = packing.IdBytes(BYTE, memo_words=50, long_chars=4000)
    draw = random.Random(6)
    texts = [*ODD, "a" * 5000, "x" + " " * 5000 + "y", "\n" * 3000, "it's we'll I'D 'S\t\t x  1234 ½²³ ªº ß\xa0\x85 z", "\x1c\x1f", "<|endoftext|>"]
    texts += ["".join(draw.choices("abcdefghinorstu éßñ' 019.,\n", k=draw.randint(1, 400))) for _ in range(400)]
    assert ids_of._by_rank is not None
    for text in texts:
        want = t.encode(text, add_special_tokens=False).ids
        assert ids_of(text) == np.array(want, dtype="<u4").tobytes()


def test_packing(spark, docs, rows):
    t = tokenizers.Tokenizer.from_file(BYTE)
    capacity = 256
    got = packing.pack(docs, BYTE, capacity).collect()
    want = collections.Counter()
    total = 0
    for i, x in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], dtype="<u4")
        total += len(ids)
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[i, k, a, z - a, zlib.crc32(ids[a:z].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    planned = packing.plan(collections.Counter(r.length for r in got), capacity)
    assert collections.Counter(tuple(sorted(r.length for r in b)) for b in bins.values()) == sum((collections.Counter({tuple(sorted(taken)): n}) for taken, n in planned), collections.Counter())
    assert len(bins) <= 1.03 * -(-total // capacity) + 1
    assert packing.pack(made(spark, []), BYTE).count() == 0
    same = packing.pack(made(spark, [(1, "a b c")] * 7 + [(None, "a b c"), (2, None)]), BYTE, 4).collect()  # ties, repeats
    assert collections.Counter(r.length for r in same) == {4: 8, 1: 1} and len({(r.sequence_id, r.offset) for r in same}) == 9
    assert packing.plan({6: 2, 5: 2, 4: 2, 1: 2}, 10) and sum(n * len(b) for b, n in packing.plan({6: 2, 5: 2, 4: 2, 1: 2}, 10)) == 8


def test_crf(spark):
    good = [(3 * i, " ".join(random.Random(i).choices("the of and a small river town was seen by many people".split(), k=40)) + ".\nIt was so.") for i in range(60)]
    bad = [(3 * i + 1, "\n".join(" ".join(random.Random(i).choices(["BUY!!", "NOW!!", "$$$", "WIN%%%"], k=12)) for _ in range(3))) for i in range(60)]
    table = made(spark, good + bad + [(900, None), (901, ""), (None, "the town")])
    labels = spark.createDataFrame([(i, 1, "x") for i, _ in good] + [(i, 0, "x") for i, _ in bad] + [(None, 1, "x"), (5, None, "x")], "doc_id long, quality int, text string")
    got = {r.doc_id: r for r in crf_quality.score_quality(table, labels).collect()}
    assert len(got) == 123 and all(got[i].predicted == 1 for i, _ in good) and all(got[i].predicted == 0 for i, _ in bad)
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert got[900].score == got[901].score and 0 <= got[900].score <= 1
    assert all(abs(r.score - 0.5) < 1e-9 for r in crf_quality.score_quality(table, labels.filter("false")).collect())
    assert crf_quality.score_quality(made(spark, []), labels).count() == 0


def test_crf_scores_by_brute_force():
    """Line scores as features times weights, in blocks of any size; documents as the length-weighted mean of marginals."""
    draw = np.random.default_rng(5)
    field = crf_quality.Field(draw.normal(size=crf_quality.N_FEATURES), draw.normal(size=(2, 2)), draw.normal(size=crf_quality.N_FEATURES), draw.uniform(0.5, 2, crf_quality.N_FEATURES), 0.3)
    docs = [[b"the town", b"BUY $$$ BUY", b"the town"], [], [b"x 1 2"], [b"a, b!", "é ß".encode(), b"a, b!", b"|"]]
    table = crf_quality._table()
    want = ((crf_quality.features(docs, table) - field.center) / field.scale) @ field.weights
    for block in (1, 2, 100):
        assert np.allclose(field.unary(docs, table, block), want)
    at, means = 0, []
    for d in docs:
        u, at = want[at : at + len(d)], at + len(d)
        paths = [[(n >> k) & 1 for k in range(len(d))] for n in range(2 ** len(d))]
        weight = [np.exp(sum(u[k] * s for k, s in enumerate(p)) + sum(field.transitions[a, b] for a, b in zip(p, p[1:]))) for p in paths]
        good = [sum(w for w, p in zip(weight, paths) if p[k]) / sum(weight) for k in range(len(d))]
        means.append(np.average(good, weights=[len(x) for x in d]) if d else 0.3)
    assert np.allclose(crf_quality.score_group(docs, field, table), means)
    own = crf_quality.own_measures([b"ab AB 1 ab", b"x", b"x"], table)
    assert np.allclose(own[0], [0.4, 0.2, 0.1, 0.3, 0, 0, 0, 0, 0, 0, 0.5, 0, 0.25, 10 / 4 / 16, 0, np.log(11) / 8]) and own[:, 14].tolist() == [0, 0, 1]


def test_crf_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = crf_quality.score_quality(docs, labels).filter("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    good, bad = [r.score for r in scored if r.quality == 1], [r.score for r in scored if r.quality == 0]
    area = np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good])
    print("held-out AUC", area, len(scored))
    assert len(scored) > 80 and area >= 0.97


def test_crf_of_a_very_long_text(spark):
    text = "\n".join(f"line {k} of it" for k in range(60_000))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = crf_quality.score_quality(made(spark, [(1, "the town"), (2, "$$$ !!!"), (3, text), (3, text)]), labels).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id == 3}) == 1


def test_lexicon_of_bounded_size():
    """Words without shared ends, longer than the room for them: the lexicon holds the first ones, ids stay the library's."""
    draw = random.Random(3)
    words = ["".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(60)) for _ in range(300)]
    data = bpe_lexicon.lexicon(words, WORD, 200_000)
    assert 20_000 < len(data) <= 200_000
    t = tokenizers.Tokenizer.from_file(WORD)
    encoder = bpe_lexicon.Encoder(WORD, data)
    assert encoder.encode_many([" ".join(words)]) == [t.encode(" ".join(words), add_special_tokens=False).ids]
    assert len(bpe_lexicon.lexicon(words, WORD, 10)) < 300


def test_crf_learns_from_whole_texts(spark):
    line = lambda i, words: " ".join(random.Random(i).choices(words, k=9))
    prose = lambda i, n: [line(f"{i} {k}", "the of and a small river town was seen by many people".split()) for k in range(n)]
    junk = lambda i, n: [line(f"{i} {k}", ["BUY!!", "NOW!!", "$$$", "WIN%%%"]) for k in range(n)]
    good = [(i, "\n".join(prose(i, 50))) for i in range(30)]
    bad = [(100 + i, "\n".join(prose(i, 50) + junk(i, 60 + 9 * i))) for i in range(30)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    table = made(spark, good + bad + [(900, "\n".join(junk("x", 5)))])
    x, _ = crf_quality.training_sample(table, labels, 3000, "doc_id", "text")
    assert max(map(len, x)) > 110
    assert {r.doc_id: r.score for r in crf_quality.score_quality(table, labels).collect()}[900] < 0.2
    assert crf_quality.alike(np.array([1, 1, 2, 500, 600, 9000])) == [slice(0, 3), slice(3, 5), slice(5, 6)]


def test_marginals_by_enumeration():
    draw = np.random.default_rng(2)
    u, tr = draw.normal(size=(1, 4)), draw.normal(size=(2, 2))
    good, pairs = crf_quality.marginals(u, np.ones((1, 4), dtype=bool), tr)
    paths = [[(n >> k) & 1 for k in range(4)] for n in range(16)]
    weight = [np.exp(sum(u[0, k] * s for k, s in enumerate(p)) + sum(tr[a, b] for a, b in zip(p, p[1:]))) for p in paths]
    want = [sum(w for w, p in zip(weight, paths) if p[k]) / sum(weight) for k in range(4)]
    assert np.allclose(good[0], want) and np.isclose(pairs.sum(), 3)


def test_secrets(spark):
    key = "A1b2C3d4E5f6G7h8I9"
    rows = [(1, f'é password = "{key}" x'), (2, "token: abcde"), (3, "AKIA" + "Z9" * 9 + " " + "0a" * 15), (4, None), (5, ""), (None, "secret=xyz123")]
    rows += [(10 + k, f"api_key={'9z' * 10}") for k in range(4)]
    got = {r.doc_id: r for r in secret_scan.secret_scan(made(spark, rows)).collect()}
    assert len(got) == len(rows)
    start = 2
    assert got[1].spans == f"assign:{start}:{start + 12 + len(key)},live:{start + 12}:{start + 12 + len(key)}"
    assert got[1].base_sha256 == hashlib.sha256(f"assign:{start}:{start + 12 + len(key)}".encode()).hexdigest()
    assert got[2].n_assign == 0 and got[2].spans == "" and got[None].n_assign == 1
    assert (got[3].n_access, got[3].n_hex) == (1, 1) and got[10].n_live == 0 and got[10].most_owners == 4
    assert got[4].base_sha256 == hashlib.sha256(b"").hexdigest() == got[5].base_sha256
    texts = {r.doc_id: r.text for r in secret_scan.without_secrets(made(spark, rows)).collect()}
    assert texts[1] == 'é password = "[redacted]" x' and texts[10] == rows[6][1] and texts[4] is None and len(texts) == len(rows)
    assert secret_scan.secret_scan(made(spark, [])).count() == 0


def test_secrets_of_very_long_texts(spark):
    """Matches by the ten thousand in one text: positions by brute force, and work that doesn't grow with their square."""
    draw = random.Random(4)
    runs = ["".join(draw.choices("0123456789abcdef", k=draw.randint(20, 40))) for _ in range(30_000)]
    text = "é" + " ü".join(runs)
    docs = made(spark, [(1, text), (2, "token=" + "q" * 30_000), (3, text[:5000])])
    start = time.perf_counter()
    got = {r.doc_id: r for r in secret_scan.secret_scan(docs).collect()}
    want = [(m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    assert got[1].n_hex == len(want) and got[1].base_sha256 == hashlib.sha256(",".join(f"hex:{a}:{z}" for a, z in want).encode()).hexdigest()
    live = [(s.start, s.end) for s in got[1].live]
    assert live == [(a, z) for a, z in want if re.search("[0-9]", text[a:z]) and re.search("[a-f]", text[a:z])]
    cleaned = {r.doc_id: r.text for r in secret_scan.without_secrets(docs).collect()}[1]
    out, at = [], 0
    for a, z in live:
        out.append(text[at:a] + "[redacted]")
        at = z
    assert cleaned == "".join(out) + text[at:]
    assert time.perf_counter() - start < 60


def test_secrets_by_repositories(spark):
    """A value in many repositories of two owners is a copied example; one in few isn't."""
    row = lambda i, key, source, lang: (i, f"token={key} ", lang, source)
    many = [row(k, "A1b2C3d4E5f6G7h8", f"s{k % 2}", f"l{k}") for k in range(5)]
    few = [row(10 + k, "Z9y8X7w6V5u4T3s2", f"s{k % 2}", f"l{k % 4}") for k in range(20)]
    docs = spark.createDataFrame(many + few, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in secret_scan.secret_scan(docs).collect()}
    assert all(got[k].n_live == 0 and (got[k].most_owners, got[k].most_repos) == (2, 5) for k in range(5))
    assert all(got[k].n_live == 1 and (got[k].most_owners, got[k].most_repos) == (2, 4) for k in range(10, 30))


def test_redaction_of_overlapping_spans(spark):
    rows = [("xx0123456789yy", [(2, 5), (4, 8), (8, 10)]), ("é12", [(1, 3)]), ("abc", []), ("ab", [(0, 2)])]
    span = "array<struct<start:bigint,end:bigint>>"
    docs = spark.createDataFrame(rows, f"text string, `live spans` {span}")
    got = [r[0] for r in docs.select(secret_scan.redacted("text", "live spans", "#")).collect()]
    assert got == ["xx##89yy", "é#", "abc", "#"]


def test_secrets_of_rows_without_an_id_of_their_own(spark):
    keys = [f"A1b2C3d4E5f6G7h8{k}" for k in range(5)]
    rows = [(None, f"x token={keys[0]}"), (None, f"yy token={keys[1]} z"), (None, "plain"), (None, None), (7, f"token={keys[2]}"), (7, f"é secret: {keys[3]} {keys[3]}"), (7, "plain"), (8, f"token={keys[4]}"), (8, f"token={keys[4]}")]
    got = secret_scan.without_secrets(made(spark, rows))
    texts = [(r.doc_id, r.text) for r in got.collect()]
    want = [(None, "x token=[redacted]"), (None, "yy token=[redacted] z"), (None, "plain"), (None, None), (7, "token=[redacted]"), (7, f"é secret: [redacted] {keys[3]}"), (7, "plain"), (8, "token=[redacted]"), (8, "token=[redacted]")]
    assert collections.Counter(texts) == collections.Counter(want) and got.columns == made(spark, rows).columns
