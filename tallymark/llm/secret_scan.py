"""Secret scan with corpus-wide ownership, in DataFrame expressions only.

Detectors find candidate spans in whole texts.  The hash of each candidate's value is counted over the corpus by
distinct repositories and distinct owners.  A value that several owners hold, or that stands in many repositories, is a
widely copied example; one that few hold and that looks random is reported as live.  Counting pre-aggregates (hash,
repository, owner) in each task, so one value in a third of all rows shuffles as a few rows.

Work on one text follows its length: what needs the position of every match is a running sum over the lengths of the
matches and of what lies between them, and no expression grows an array or a string match by match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored, text_key

# The detectors' patterns (pattern, group of the value, least characters of that group).
BASE_DETECTORS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
MORE_DETECTORS = {
    "github": (r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 60),
}
# A cheaper test that every text with a lasting match passes.
_PRETESTS = {"access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
# Maximal runs: a run that is too short can be left out of the search itself, as no longer run starts inside it.
_SEARCHES = {"access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
KINDS = (*BASE_DETECTORS, *MORE_DETECTORS, "live")
_SPAN = "struct<start:long,kind_no:int,end:long,value_start:long,value:string>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` in which ``name`` is ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(values: str, join: Callable[[str, str], str]) -> str:
    """SQL of the running totals of an array of longs, by ``join`` from 0 on.

    An array can only grow by being copied.  So runs of the cube root of its length are totalled first, then every run
    from the total before it: the work is the length to the power of 4/3.
    """
    grow = f"(p, q) -> concat(p, array({join('element_at(p, -1)', 'q')}))"
    size = "greatest(8, cast(ceil(cbrt(size(v))) as int))"
    runs = "if(size(v) = 0, cast(array() as array<array<bigint>>), transform(sequence(0, (size(v) - 1) div n), i -> slice(v, i * n + 1, n)))"
    before = f"aggregate(transform(r, x -> aggregate(x, 0L, (p, q) -> {join('p', 'q')})), array(0L), {grow})"
    inner = f"zip_with(r, slice(b, 1, size(r)), (x, y) -> slice(aggregate(x, array(y), {grow}), 2, size(x)))"
    return _let("v", values, _let("n", size, _let("r", runs, _let("b", before, f"flatten({inner})"))))


def _spans(kind: str, detector: tuple[str, int, int]) -> Column:
    """Spans of one detector, leftmost first and without overlap, in code points.

    The pieces between matches and the matches themselves make up the text, so running sums of their lengths are the
    matches' ends.
    """
    pattern, group, least = detector
    search = _quoted(_SEARCHES.get(kind, pattern))
    value = "m" if group == 0 else f"regexp_extract(m, {_quoted(pattern)}, {group})"
    parts = f"named_struct('m', regexp_extract_all(text, {search}, 0), 'between', transform(split(text, {search}, -1), x -> length(x)))"
    steps = "zip_with(a.m, slice(a.between, 1, size(a.m)), (m, x) -> cast(length(m) + x as bigint))"
    span = f"""named_struct('start', e - length(m), 'kind_no', {KINDS.index(kind)}, 'end', e,
        'value_start', e - length({value}), 'value', {value})"""
    spans = f"filter(zip_with(a.m, z, (m, e) -> {span}), s -> length(s.value) >= {least})"
    found = _let("a", parts, _let("z", _running(steps, lambda p, q: f"{p} + {q}"), spans))
    none = f"cast(array() as array<{_SPAN}>)"
    return F.expr(f"if(text rlike {_quoted(_PRETESTS.get(kind, _SEARCHES.get(kind, pattern)))}, cast({found} as array<{_SPAN}>), {none})")


def _listing(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["kind_no"], s["end"])))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(ordered, one), ",")


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: list[str]) -> DataFrame:
    """One narrow row per input row with its spans; whole texts are read and left behind."""
    owner = docs[owner_col].cast("string") if owner_col in docs.columns else F.lit(None).cast("string")
    repo = F.to_json(F.struct(*[docs[c].cast("string").alias(f"r{i}") for i, c in enumerate(repo_cols) if c in docs.columns]))
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        owner.alias("owner"),
        repo.alias("repo"),
    )
    detectors = BASE_DETECTORS | MORE_DETECTORS
    rows = rows.select("doc_id", "owner", "repo", text_key(F.col("text")).alias("text_key"), *[_spans(k, d).alias(f"s_{k}") for k, d in detectors.items()])
    return rows.select(
        "doc_id",
        "owner",
        "repo",
        F.when(F.size(F.concat(*[f"s_{k}" for k in detectors])) > 0, F.col("text_key")).alias("text_key"),
        *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in BASE_DETECTORS],
        F.concat(*[f"s_{k}" for k in BASE_DETECTORS]).alias("base"),
        F.concat(*[f"s_{k}" for k in detectors]).alias("found"),
    )


def secret_scan(
    docs: DataFrame,
    min_owners: int = 3,
    min_repos: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_cols: tuple[str, ...] = ("source", "lang"),
) -> DataFrame:
    """One row per input row: the base counts and digest, and all spans with their ownership.

    ``found`` holds every span with its value, ``live`` those of values that fewer than ``min_owners`` owners hold, that
    stand in fewer than ``min_repos`` repositories, and that look random (16 characters or more, with a digit and a
    letter).  ``repo_cols`` together name a repository.  A null owner counts as one owner of its own kind.  Null and
    empty texts have no spans; repeated rows are scanned each and add no owner; an empty table gives an empty result;
    columns of other names are ignored.
    """
    rows = candidates(docs, id_col, text_col, owner_col, list(repo_cols)).withColumn(
        "row_key",
        F.when(
            F.size("found") > 0,
            F.sha2(F.concat_ws("\x00", F.col("doc_id").cast("string"), F.to_json(F.struct("found"))), 256),
        ),
    )
    rows = stored(rows, "secret-candidates")
    held = rows.filter(F.col("row_key").isNotNull())
    single = held.select("row_key", "owner", "repo", F.explode("found").alias("span")).select(
        "row_key", "owner", "repo", "span", F.sha2("span.value", 256).alias("value_hash")
    )
    owners = (
        single.select("value_hash", F.coalesce("owner", F.lit("")).alias("owner"), "repo")
        .distinct()
        .groupBy("value_hash", "owner")
        .agg(F.count(F.lit(1)).alias("repos"))
        .groupBy("value_hash")
        .agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))
    )
    # written first: a join with a finished table can be split where very many rows hold one value
    owners = stored(owners, "secret-owners")
    judged = single.select("row_key", "span", "value_hash").distinct().join(owners, "value_hash")
    value = F.col("span.value")
    looks_live = (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    few = (F.col("n_owners") < min_owners) & (F.col("n_repos") < min_repos)
    place = F.col("span.value_start")
    as_live = F.struct(place.alias("start"), F.lit(KINDS.index("live")).alias("kind_no"), F.col("span.end").alias("end"), place.alias("value_start"), value.alias("value"))
    by_row = judged.groupBy("row_key").agg(
        F.collect_set(F.when(looks_live & few, as_live)).alias("live"),  # within one row
        F.max("n_owners").alias("most_owners"),
        F.max("n_repos").alias("most_repos"),
    )
    by_row = stored(by_row, "secret-verdicts")
    out = held.join(by_row, "row_key", "left").unionByName(
        rows.filter(F.col("row_key").isNull())
        .withColumn("live", F.array().cast(f"array<{_SPAN}>"))
        .withColumn("most_owners", F.lit(0).cast("long"))
        .withColumn("most_repos", F.lit(0).cast("long"))
    )
    return (
        out.withColumn("live", F.sort_array("live"))
        .withColumn("n_live", F.size("live").cast("long"))
        .select(
            "doc_id",
            *[f"n_{k}" for k in BASE_DETECTORS],
            F.sha2(_listing(F.col("base")), 256).alias("base_sha256"),
            _listing(F.concat("found", "live")).alias("spans"),
            "n_live",
            "most_owners",
            "most_repos",
            "found",
            "live",
            "text_key",
        )
    )


def redacted(text: str, live: str, mark: str = "[redacted]") -> Column:
    """The text in column ``text`` with each span of column ``live``, sorted by start, replaced; overlapping spans once.

    A span's place is found from the front of its run of spans, and a run's from the front of the text; there are as
    many runs as spans in each, so work is the text's length by the square root of the number of spans.
    """
    ends = _running("transform(s, x -> x.end)", lambda p, q: f"greatest({p}, {q})")  # how far spans up to each one reach
    parts = """zip_with(zip_with(transform(s, x -> x.start), concat(array(0L), slice(z, 1, size(z) - 1)), (x, y) -> named_struct('start', x, 'done', y)),
        z, (x, y) -> named_struct('start', x.start, 'done', x.done, 'reach', y))"""
    runs = "transform(sequence(0, (size(c) - 1) div n), i -> slice(c, i * n + 1, n))"
    kept = "substring(t, cast(x.done - f + 1 as int), cast(x.start - x.done as int))"
    piece = f"if(x.start < x.done, '', concat({kept}, {_quoted(mark)}))"
    whole = f"substring(`{text}`, cast(f + 1 as int), cast(element_at(r, -1).reach - f as int))"
    one = _let("f", "element_at(r, 1).done", _let("t", whole, f"array_join(transform(r, x -> {piece}), '')"))
    tail = f"substring(`{text}`, cast(element_at(z, -1) + 1 as int))"
    joined = _let("c", parts, _let("n", "cast(ceil(sqrt(size(c))) as int)", f"array_join(transform({runs}, r -> {one}), '')"))
    body = _let("s", f"`{live}`", _let("z", ends, f"concat({joined}, {tail})"))
    return F.expr(f"if(size(`{live}`) > 0, {body}, `{text}`)")


def without_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows with live values redacted from their texts; all rows and columns stay.

    Spans follow from a row's text, so rows without an id, and rows of one id with different texts, each get their own.
    Null and empty texts stay; repeated rows are redacted alike; an empty table gives an empty result; columns of any
    other name stay.
    """
    found = secret_scan(docs, id_col=id_col, text_col=text_col, **options)
    own, key, spans = (free_name(docs.columns, n) for n in ("live_id", "live_key", "live_spans"))
    live = found.filter("n_live > 0").select(F.col("doc_id").alias(own), F.col("text_key").alias(key), F.col("live").alias(spans))
    live = live.dropDuplicates([own, key])
    same = docs[id_col].cast("long").eqNullSafe(F.col(own)) & (text_key(docs[text_col]) == F.col(key))
    return docs.join(live, same, "left").withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(redacted(text_col, spans))).select(*docs.columns)
