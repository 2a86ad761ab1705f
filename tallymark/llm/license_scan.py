"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame expressions only.

A block is ``BLOCK`` consecutive words, whatever lines they stand on, and one begins at every ``STEP``-th word, so any
notice of up to ``STEP`` + 1 words lies whole in a block.  A block belongs to a template if it holds at least
``threshold`` of the template's distinct words.  Words are put in one global order, rarest in the corpus first.  Both
sides are cut to the part of the vocabulary that templates use, in that order.  An inverted index has the rarest
``n - need + 1`` words of every template, ``need`` being the overlap it must have; blocks post theirs, and a pair that
meets is compared in full only if it passes filters that lose nothing:

* length: the block has at least as many template words as the overlap must have;
* prefix: the word they meet at is among the rarest of the block too;
* position: what can still follow that word on both sides is enough.

The index follows from the templates alone, some hundreds of rows, so it is broadcast.  Rows move by their text's digest,
and only those that have a block with a word of the index.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, id_and_text, stored, text_key

# Phrases whose places are counted, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wording of common license notices.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-terms": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "apache-2.0-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "boost-1.0": "distributed under the boost software license version 1 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-short": "licensed under cc by 4 0",
    "cc0-1.0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "epl-2.0": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee",
    "mit": "released under the mit license",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license",
    "ofl-1.1": "this font software is licensed under the sil open font license version 1 1",
    "proprietary": "all rights reserved",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable",
}
BLOCK, STEP = 64, 32
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spaced(lowered: Column) -> Column:
    """The words with one space between them, none at the ends."""
    return F.trim(F.regexp_replace(lowered, SEPARATORS, " "))


def _spaces_before(padded: Column, position: Column) -> Column:
    before = F.substring(padded, F.lit(1), position - 1)
    return (F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))).cast("long")


def _first_start(padded: Column, phrase: str) -> Column:
    return _spaces_before(padded, F.instr(padded, F.lit(f" {phrase} ")))


def _last_start(padded: Column, phrase: str) -> Column:
    mark = f" {phrase} "
    from_end = F.instr(F.reverse(padded), F.lit(mark[::-1]))
    return _spaces_before(padded, F.length(padded) - from_end + 2 - len(mark))


def word_order(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary of the templates by document frequency over all rows, rarest first (ties by the word).

    ``words`` has a column ``words``, an array.  The result is as long as the vocabulary, which the templates fix.
    """
    held = F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary]))
    counts = {r["word"]: r["n"] for r in words.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def license_scan(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: word count, places of the base phrases, labels and the best containment of any block.

    Null and empty texts have no words, no labels and score 0; repeated rows are scanned each; an empty table gives an
    empty result; other columns are ignored.
    """
    rows = id_and_text(docs, id_col, text_col).select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("low"))
    rows = rows.withColumn("spaced", _spaced(F.col("low"))).withColumn("words", F.split("spaced", " "))

    sets = {label: sorted(set(text.split())) for label, text in templates.items()}
    vocabulary = sorted({w for s in sets.values() for w in s})
    order = word_order(rows.select("words"), vocabulary)
    rank = {w: i for i, w in enumerate(order)}
    literal = lambda words: F.array(*[F.lit(w) for w in words]).cast("array<string>")

    prepared = []
    for label, words in sorted(sets.items()):
        ordered = sorted(words, key=rank.__getitem__)
        prepared.append((label, ordered, max(1, ceil(round(threshold * len(ordered), 9)))))
    rare = sorted({w for _, ordered, need in prepared for w in ordered[: len(ordered) - need + 1]})
    least = min((need for _, _, need in prepared), default=1)

    n_blocks = F.greatest(F.lit(1), F.ceil(F.size("words") / STEP) - 1).cast("int")
    in_order = lambda i: F.array_intersect(literal(order), F.slice("words", i * STEP + 1, F.lit(BLOCK)))
    blocks = F.filter(F.transform(F.sequence(F.lit(0), n_blocks - 1), in_order), lambda b: F.size(b) >= least)
    none = F.array().cast("array<array<string>>")
    padded = F.concat(F.lit(" "), F.col("spaced"), F.lit(" "))

    counts, firsts, lasts, base_labels = [], [], [], []
    for phrase, label in BASE_PHRASES.items():
        held = F.contains(padded, F.lit(f" {phrase} "))
        counts.append(F.when(held, F.regexp_count(padded, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0).cast("long"))
        firsts.append(F.when(held, _first_start(padded, phrase)))
        lasts.append(F.when(held, _last_start(padded, phrase)))
        base_labels.append(F.when(held, F.lit(label)))
    joined = lambda column: F.array_join(F.array_sort(F.array_distinct(column)), ",")

    rows = rows.withColumn("blocks", F.when(F.arrays_overlap("words", literal(rare)), blocks).otherwise(none)).select(
        "doc_id",
        F.when(F.size("blocks") > 0, text_key(F.col("low"))).alias("text_key"),
        "blocks",
        F.when(F.col("spaced") == "", 0)
        .otherwise(F.length("spaced") - F.length(F.replace("spaced", F.lit(" "), F.lit(""))) + 1)
        .cast("long")
        .alias("n_words"),
        sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_compact(F.array(*base_labels)).alias("base"),
    )
    rows = stored(rows, "license-blocks")
    with_blocks = rows.filter("text_key is not null")
    # one row per text that belongs to a template; written first, so that a join can be split where many rows hold one text
    hits = stored(_hits(with_blocks, prepared, least), "license-hits")
    found = with_blocks.join(hits, "text_key", "left").unionByName(rows.filter("text_key is null"), allowMissingColumns=True)
    joined = lambda column: F.array_join(F.array_sort(F.array_distinct(column)), ",")
    labels = F.coalesce("found", F.array().cast("array<string>"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
        joined(F.concat(F.col("base"), labels)).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _hits(rows: DataFrame, prepared: list[tuple[str, list[str], int]], least: int) -> DataFrame:
    """(text_key, found, score): the templates any block of a text belongs to and the greatest containment."""
    quoted = lambda words: "array(" + ", ".join(f"'{w}'" for w in words) + ")"
    entries = [
        f"('{word}', '{label}', {at}, {need}, {quoted(ordered)})"
        for label, ordered, need in prepared
        for at, word in enumerate(ordered[: len(ordered) - need + 1])
    ]
    none = "SELECT '' AS word, '' AS label, 0 AS at, 0 AS need, array('') AS template WHERE false"
    index = rows.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(entries)} AS t(word, label, at, need, template)" if entries else none)
    blocks = rows.select("text_key", F.explode("blocks").alias("block"))
    posted = blocks.select("text_key", "block", F.posexplode(F.slice("block", F.lit(1), F.size("block") - (least - 1))).alias("place", "word"))
    length = F.size("block") >= F.col("need")
    prefix = F.col("place") <= F.size("block") - F.col("need")
    position = F.least(F.size("template") - F.col("at"), F.size("block") - F.col("place")) >= F.col("need")
    met = posted.join(F.broadcast(index), "word").filter(length & prefix & position)
    met = met.withColumn("overlap", F.size(F.array_intersect("template", "block"))).filter("overlap >= need")
    return met.groupBy("text_key").agg(F.collect_set("label").alias("found"), F.max(F.col("overlap") / F.size("template")).alias("score"))


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> str:
    """The same rows in DuckDB SQL, comparing every block with every template."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    spaced = lambda x: f"trim(regexp_replace({x}, '{SEPARATORS}', ' ', 'g'))"
    rows = ", ".join(
        f"('{label}', [{', '.join(repr(w) for w in sorted(set(text.split())))}])" for label, text in sorted(templates.items())
    )
    places = []
    for phrase, label in BASE_PHRASES.items():
        test = " and ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split(), 1))
        places.append((label, f"list_filter(range(len(w)), lambda i: {test})"))
    every = f"list_concat({places[0][1]}, list_concat({places[1][1]}, {places[2][1]}))"
    base = ", ".join(f"case when len({found}) > 0 then '{label}' end" for label, found in places)
    return f"""
WITH low AS (SELECT row_number() over () AS rid, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS low FROM documents),
words AS (SELECT rid, doc_id, low, {spaced('low')} AS s, string_split({spaced('low')}, ' ') AS w FROM low),
tpl(label, tok) AS (VALUES {rows}),
places AS (SELECT rid, w, unnest(range(0, greatest(1, ceil(len(w) / {STEP}) - 1)::BIGINT)) AS b FROM words),
bags AS (SELECT rid, list_distinct(w[b * {STEP} + 1 : b * {STEP} + {BLOCK}]) AS bag FROM places),
hit AS (SELECT rid, label, len(list_intersect(tok, bag))::DOUBLE / len(tok) AS c FROM bags, tpl
        WHERE len(list_intersect(tok, bag)) >= ceil(round({threshold} * len(tok), 9))),
best AS (SELECT rid, list(label) AS labels, max(c) AS score FROM hit GROUP BY rid),
base AS (SELECT rid, doc_id, CASE WHEN s = '' THEN 0 ELSE len(w) END AS n_words, {every} AS places,
         list_filter([{base}], lambda x: x IS NOT NULL) AS names FROM words)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word,
  list_max(places)::BIGINT AS last_word, array_to_string(list_sort(list_distinct(names)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(names, coalesce(labels, [])))), ',') AS labels,
  coalesce(score, 0.0)::DOUBLE AS score
FROM base LEFT JOIN best USING (rid)
"""
