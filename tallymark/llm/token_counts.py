"""Token counts through a digest cache.

The cache is a table (tokenizer_digest, content_digest, n_tokens).  Contents that it lacks are encoded once each,
whatever number of rows hold them, and appended.  Texts move once, packed, and only a task's first row of each
content; the counts come back by a join on digests.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, scratch_root, stored

_SEEN = 200_000  # contents a task remembers; one met again later is encoded again, to the same count
_CACHE = "tokenizer_digest string, content_digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """The tokenizer's version: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class PieceCounter:
    """Numbers of tokens of texts, for one task.

    In a piece vocabulary without a space inside or at the end of a piece that has letters, no merge crosses from a
    letter to a space, so a text's count is the sum over its words with their leading spaces.  The vocabulary is
    checked for that; where it doesn't hold, and for texts with the space's own letter, whole texts are encoded.
    """

    _SPACE = "▁"
    _WORDS = re.compile(" *[^ ]+| +")

    def __init__(self, path: str, memo_words: int = 300_000):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self._model.id_to_piece(i) for i in range(self._model.get_piece_size()))
        probe = "ﬁ ① x　y\tz"
        self._by_word = all(self._SPACE not in p.lstrip(self._SPACE) for p in pieces) and (
            self._model.normalize(probe) == self._SPACE + probe.replace(" ", self._SPACE)
        )
        self._lone = len(self._model.encode("a ")) - len(self._model.encode("a"))
        self._memo: dict[str, int] = {}
        self._memo_words = memo_words

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self._by_word or self._SPACE in text or "\0" in text:
            return len(self._model.encode(text))
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = [w[1:] for w in self._WORDS.findall(" " + text)]
        else:
            words = text.split(" ")
        fresh = list(set(words).difference(self._memo))
        if fresh:
            if len(self._memo) > self._memo_words:
                self._memo.clear()
                fresh = list(set(words))
            counts = map(len, self._model.encode(fresh, num_threads=1))
            self._memo.update(zip(fresh, counts))
            if "" in self._memo:  # a single space at the text's end
                self._memo[""] = self._lone
        return sum(map(self._memo.__getitem__, words))


def _packed(batches):
    """A task's first row of each content: its digest and its text, compressed for the shuffle."""
    codec = pa.Codec("zstd", compression_level=1)
    seen: set[bytes] = set()
    for b in batches:
        digests, sizes, texts = [], [], []
        for t in b.column(0):
            data = (t.as_py() or "").encode("utf-8", "replace")
            d = hashlib.sha256(data).digest()
            if len(seen) >= _SEEN:
                seen.clear()
            if d not in seen:
                seen.add(d)
                digests.append(d)
                sizes.append(len(data))
                texts.append(codec.compress(data, asbytes=True) if data else b"")
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary())], names=["content_digest", "size", "packed"])


def _counting(path: str, version: str):
    def run(batches):
        codec, counter = pa.Codec("zstd"), None
        seen: set[bytes] = set()
        for b in batches:
            digests, counts = [], []
            for d, size, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if d in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(d)
                counter = counter or PieceCounter(path)
                text = codec.decompress(data.as_buffer(), size, asbytes=True).decode("utf-8") if size else ""
                digests.append(d)
                counts.append(counter.count(text))
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(digests), pa.string()), pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], names=["tokenizer_digest", "content_digest", "n_tokens"])

    return run


def token_counts(
    docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; the cache at ``cache_path`` gains what it lacked.

    Without a path the cache is a table of this call in the shared folder.  Contents are normalised as far as counts
    can't change: null is empty, and text is its UTF-8 bytes.  Null and empty texts have 0 tokens; repeated rows get
    equal values and are encoded once; an empty table gives an empty result; other columns are ignored.
    """
    import uuid

    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    path = cache_path or f"{scratch_root(spark)}/tallymark/token-cache-{uuid.uuid4().hex}"
    rows = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))

    contents = rows.select("text").mapInArrow(_packed, "content_digest binary, size long, packed binary")
    if _exists(spark, path):
        known = spark.read.schema(_CACHE).parquet(path).filter(F.col("tokenizer_digest") == version)
        contents = contents.join(known.select("content_digest").distinct(), "content_digest", "left_anti")
    misses = contents.repartition("content_digest").mapInArrow(_counting(tokenizer_path, version), _CACHE)
    misses.write.mode("append").parquet(path)

    # written first: a join with a finished table can be split where very many rows hold one content
    counts = stored(
        spark.read.schema(_CACHE)
        .parquet(path)
        .filter(F.col("tokenizer_digest") == version)
        .groupBy("content_digest")
        .agg(F.max("n_tokens").alias("n_tokens")),  # concurrent runs may both have appended a content
        "token-counts",
    )
    keyed = rows.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("content_digest")
    )
    return keyed.join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
