"""Rule-based document quality: counts, repetition, and divergence from language references.

Every document is measured once.  Two of its histograms (character classes; common words) are compared by
Jensen-Shannon distance with references.  A reference is the whole corpus's summed histogram of one language, so the
references are a handful of short rows whatever the corpus's size, and collecting them is bounded by
``max_languages``.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, each_row, stored, to_arrow

# Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to a in is it that for was on are with as be by this from or an not",
    "fr": "le la les de des du et un une est que qui dans pour par sur au aux en ce il elle",
    "de": "der die das und in zu den ist mit von ein eine für auf des dem im nicht sich auch als an",
    "es": "el la los las de del y un una es que en por para con se su al lo como no",
}
# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
CHAR_CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "punctuation", "symbol", "letter_beyond_ascii", "control")

_VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words.split()})


def _class_table() -> np.ndarray:
    table = np.full(256, CHAR_CLASSES.index("punctuation"), dtype=np.uint8)
    names = {n: i for i, n in enumerate(CHAR_CLASSES)}
    table[:32] = names["control"]
    table[127] = names["control"]
    for name, chars in (("space", b" \t"), ("newline", b"\n\r\x0b\x0c"), ("stop", b".,;:"), ("symbol", SYMBOLS.encode())):
        for c in chars:
            table[c] = names[name]
    table[ord("0") : ord("9") + 1] = names["digit"]
    table[ord("a") : ord("z") + 1] = names["lower"]
    table[ord("A") : ord("Z") + 1] = names["upper"]
    table[0xC0:] = names["letter_beyond_ascii"]
    table[0x80:0xC0] = len(CHAR_CLASSES)  # continuation bytes: their character has been counted
    return table


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. Distances lie in 0..1; a guard is the least length at which a distance decides."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_char_distance: float = 0.30
    min_chars: int = 400
    max_word_distance: float = 0.36
    min_words_for_distance: int = 100


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows that stand twice or more in the list, the first standing included."""
    grams = list(zip(*[words[i:] for i in range(window)]))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    covered, reach = 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered += i + window - max(reach, i)
            reach = i + window
    return covered


def _measure_maker():
    table = _class_table()
    probes = [[w.encode() + tail for tail in (b"", b",", b".")] for w in _VOCABULARY]
    symbols = SYMBOLS.encode()
    n_classes = len(CHAR_CLASSES)

    def measure(doc_id, text, lang):
        data = (text or "").encode("utf-8", "replace")
        words = data.split()  # bytes split at exactly \x20 and \x09-\x0D
        raw = np.frombuffer(data, dtype=np.uint8)
        classes = np.bincount(table[raw], minlength=n_classes + 1)[:n_classes]
        spaces = sum(data.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
        seen, dup_lines = set(), 0
        for line in data.split(b"\n"):
            if line in seen:
                dup_lines += 1
            elif line.split(None, 1):
                seen.add(line)
        counts = Counter(data.lower().split())
        common = [sum(counts[p] for p in forms) for forms in probes]
        return (
            doc_id,
            lang,
            len(words),
            int(np.count_nonzero((raw & 0xC0) != 0x80)) - spaces,
            sum(data.count(bytes([c])) for c in symbols),
            dup_lines,
            repeated_words(words),
            classes.tolist(),
            [*common, len(words) - sum(common)],
        )

    return measure


MEASURES = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "char_hist array<long>, word_hist array<long>"
)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts and histograms of each row, in one pass without a shuffle. Null text counts as empty."""
    lang = docs[lang_col] if lang_col in docs.columns else F.lit(None)
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), lang.cast("string").alias("lang")
    )
    return each_row(rows, MEASURES, _measure_maker, ["doc_id", "text", "lang"])


def references(measures: DataFrame) -> dict[str, tuple[list[int], list[int]]]:
    """Summed histograms by language over all rows: one short row per language, of every language."""
    n_chars, n_words = len(CHAR_CLASSES), len(_VOCABULARY) + 1
    sums = (
        measures.filter(F.col("lang").isNotNull())
        .groupBy("lang")
        .agg(
            *[F.sum(F.col("char_hist")[i]).alias(f"c{i}") for i in range(n_chars)],
            *[F.sum(F.col("word_hist")[i]).alias(f"w{i}") for i in range(n_words)],
        )
    )
    return {
        r["lang"]: ([r[f"c{i}"] for i in range(n_chars)], [r[f"w{i}"] for i in range(n_words)])
        for r in sums.collect()
    }


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of counts ``p`` to the counts ``q``; 0 where a side is empty."""
    total_p, total_q = p.sum(axis=1, keepdims=True), q.sum()
    if total_q == 0:
        return np.zeros(len(p))
    a = p / np.maximum(total_p, 1)
    b = np.broadcast_to(q / total_q, a.shape)
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        half = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1)
        out = np.sqrt(np.maximum((half(a) + half(b)) / 2, 0))
    return np.where(total_p[:, 0] > 0, out, 0.0)


VERDICTS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, char_distance double, word_distance double, nearest_lang string"
)


def quality_rules(
    docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per input row with its counts, distances and verdict.

    A row fails the base rules with fewer than ``min_words`` words or with too many words in repeated windows.  Beyond
    that it is rejected if it is long enough and its character classes or common words lie far from those of every
    language (the nearest one decides, so a wrong or null ``lang`` harms nothing).  Null and empty texts have no words
    and fail; repeated rows are judged each; an empty table gives an empty result; extra columns are ignored.
    """
    measures = stored(measure(docs, id_col, text_col, lang_col), "quality-measures")
    judge = _judge_maker(references(measures), rules)
    return measures.mapInArrow(judge, VERDICTS)


def accepted(
    docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The rows that the rules keep, whole and unchanged.

    Each row is measured where it is read and judged at once, so texts are never moved to meet their verdict.
    """
    judge = _judge_maker(references(measure(docs, id_col, text_col, lang_col)), rules)
    at = docs.columns.index(text_col)
    schema = to_arrow(docs.sparkSession, MEASURES)

    def run(batches):
        measure_row = _measure_maker()
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                rows = [measure_row(0, t.as_py(), None) for t in part.column(at)]
                for verdict in judge([as_batch(rows, schema)]):
                    yield part.filter(verdict.column("kept"))

    return docs.mapInArrow(run, docs.schema)


def _judge_maker(refs: dict[str, tuple[list[int], list[int]]], rules: Rules):
    """A function from batches of measures to batches of verdicts."""
    names = sorted(refs)

    def judge(batches):
        import pyarrow as pa

        char_refs = [np.array(refs[n][0], dtype=np.float64) for n in names]
        word_refs = [np.array(refs[n][1], dtype=np.float64) for n in names]
        for b in batches:
            col = {n: b.column(n) for n in b.schema.names}
            rows = b.num_rows
            if not rows:
                continue
            chars = np.array(col["char_hist"].flatten(), dtype=np.float64).reshape(rows, -1)
            words = np.array(col["word_hist"].flatten(), dtype=np.float64).reshape(rows, -1)
            n_words = col["n_words"].to_numpy()
            if names:
                char_d, word_d, least = (np.full(rows, np.inf) for _ in range(3))
                best = np.zeros(rows, dtype=np.int64)
                for k, (c, w) in enumerate(zip(char_refs, word_refs)):
                    by_char, by_word = js_distance(chars, c), js_distance(words, w)
                    nearer = by_char + by_word < least
                    best[nearer], least[nearer] = k, (by_char + by_word)[nearer]
                    char_d, word_d = np.minimum(char_d, by_char), np.minimum(word_d, by_word)
                nearest = pa.array([names[i] for i in best], type=pa.string())
            else:
                char_d = word_d = np.zeros(rows)
                nearest = pa.nulls(rows, pa.string())
            failed = (n_words < rules.min_words) | (100 * col["n_repeat_words"].to_numpy() > rules.max_repeat_percent * n_words)
            far = ((chars.sum(axis=1) >= rules.min_chars) & (char_d > rules.max_char_distance)) | (
                (n_words >= rules.min_words_for_distance) & (word_d > rules.max_word_distance)
            )
            yield pa.RecordBatch.from_arrays(
                [col[n] for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                + [pa.array(failed), pa.array(~failed & ~far), pa.array(char_d), pa.array(word_d), nearest],
                names=[c.split()[0] for c in VERDICTS.split(", ")],
            )

    return judge
