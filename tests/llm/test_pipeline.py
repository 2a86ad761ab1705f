import collections

import corpus_pipeline as pipeline

SMALL = "/root/testdata/sf0.001"


def test_rows_without_an_id(spark):
    """The operator's verdict holds for them, and a stage changes or drops no other row of the id."""
    words = [f"w{k}" for k in range(30)]
    rows = [(1, " ".join(words)), (None, " ".join(words)), (None, " ".join(words).upper()), (None, "only here " * 9), (None, None), (None, ""), (2, " ".join(words[:-1])), (3, "else " * 9)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    out = pipeline.near_duplicates(spark, docs, SMALL)
    want = [rows[k] for k in (0, 3, 4, 5, 7)]
    assert out.columns == docs.columns and collections.Counter((r.doc_id, r.text) for r in out.collect()) == collections.Counter(want)


def test_stages(spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "suffix-array dedup", "secret scans", "best-fit packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, texts = docs.columns, []
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL).cache()
        assert out.columns == columns and out.count() <= docs.count()
        docs = out
        texts.append({r.doc_id: r.text for r in out.collect()})
    assert texts[1].keys() < texts[0].keys() and all(texts[1][i] == texts[0][i] for i in texts[1])
    windows = collections.Counter(" ".join(w[s : s + 50]) for w in map(str.split, texts[2].values()) for s in range(len(w) - 49))
    assert max(windows.values(), default=1) == 1
    packed = pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == texts[3].keys()
