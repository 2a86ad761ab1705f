"""Paths: resolving, relating, normalising, common roots and NUL-separated lists.

Plain functions serve the driver; the column forms are array expressions that stay in the JVM.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolved(path: str, base: str = "/") -> str:
    out = posixpath.normpath(posixpath.join(base, path))
    return "/" + out.lstrip("/") if out.startswith("/") else out


def relative(root: str, path: str) -> str | None:
    """The path below the root; None if it is empty, the root itself, or outside it."""
    if not path:
        return None
    root = resolved(root)
    full = resolved(path, root)
    prefix = root if root.endswith("/") else root + "/"
    return full[len(prefix) :] or None if full.startswith(prefix) else None


def normalized(root: str, paths: Iterable[str]) -> list[str]:
    """Relative, inside the root, sorted by bytes, without repeats."""
    return sorted({r for p in paths if (r := relative(root, p))}, key=lambda p: p.encode())


def common_root(paths: Iterable[str], base: str | None = None, allowed: str | None = None) -> str:
    """The deepest directory that holds all files; "/" for the file system's root, "" if there is none.

    Relative paths start at ``base`` if it is given.  Files outside ``allowed`` don't count.
    """
    folders = []
    for p in paths:
        if not p:
            continue
        full = resolved(p, base) if base else posixpath.normpath(p)
        folder = posixpath.dirname(full)
        parts = [""] if folder == "/" else folder.split("/") if folder else []
        if allowed is None or parts[: len(limit := resolved(allowed).rstrip("/").split("/"))] == limit:
            folders.append(parts)
    if not folders:
        return ""
    low, high = min(folders), max(folders)
    n = 0
    while n < min(len(low), len(high)) and low[n] == high[n]:
        n += 1
    if not n:
        return ""
    return "/".join(low[:n]) or ("/" if low[0] == "" else "")


def encode(paths: Iterable[str]) -> bytes:
    """NUL after each path; a path with a NUL in it becomes an empty one."""
    return b"".join((b"" if "\0" in p else p.encode()) + b"\0" for p in paths)


def decode(data: bytes) -> list[str]:
    """What ``encode`` joined; an unterminated end is dropped."""
    return [p.decode() for p in data.split(b"\0")[:-1]]


def absolute(root: str, paths: Iterable[str]) -> list[str]:
    return [posixpath.join(root if root.endswith("/") else root + "/", p) for p in paths]


# ---------------------------------------------------------------- columns


def segments(path: Column) -> Column:
    """The path's segments with "." and ".." resolved; null where ".." leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("left"))

    def step(acc, s):
        up = s == ".."
        size = F.size(acc["out"])
        return F.struct(
            F.when(up & (size > 0), F.slice(acc["out"], F.lit(1), F.greatest(size - 1, F.lit(0)))).when(up, acc["out"]).otherwise(F.concat(acc["out"], F.array(s))).alias("out"),
            (acc["left"] | (up & (size == 0))).alias("left"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(~acc["left"], acc["out"]))


def relative_column(root: str, path: Column) -> Column:
    """``relative`` for a column, with a fixed root."""
    base = resolved(root).rstrip("/")
    full = segments(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(base + "/"), path)))
    n = len([s for s in base.split("/") if s])
    head = F.array(*[F.lit(s) for s in base.split("/") if s]).cast("array<string>")
    inside = (F.size(full) > n) & (F.slice(full, 1, n) == head) if n else F.size(full) > 0
    return F.when((path != "") & inside, F.array_join(F.slice(full, F.lit(n + 1), F.greatest(F.size(full) - n, F.lit(0))), "/"))


def is_safe(path: Column) -> Column:
    """Relative, without ".." segments, drive letters, backslashes in front or NULs."""
    return ~(path.rlike(r"^$|^[/\\]|^.:|(^|/)\.\.(/|$)") | F.contains(path, F.lit("\0")))


def normalized_paths(df: DataFrame, root: str, path_col: str = "path") -> DataFrame:
    """``normalized`` for a table: one row per path."""
    return df.select(relative_column(root, df[path_col]).alias("path")).filter("path is not null").distinct().orderBy("path")


def common_roots(df: DataFrame, group_col: str, path_col: str) -> DataFrame:
    """``common_root`` of each group.

    The longest common prefix of a set of segment arrays is that of its least and its greatest, and those are partial
    aggregates: no group is gathered anywhere.
    """
    parts = F.split(F.col(path_col), "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    pairs = (
        df.filter(F.col(path_col).isNotNull())
        .groupBy(F.col(group_col).alias("group"))
        .agg(F.min(folders).alias("low"), F.max(folders).alias("high"))
    )
    flags = F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False)))
    first_bad = F.array_position(flags, False)
    n = F.when(first_bad == 0, F.size(flags)).otherwise(first_bad.cast("int") - 1)
    prefix = F.slice("low", F.lit(1), n)
    root = F.when(n == 0, F.lit("")).when((n == 1) & (F.element_at(prefix, 1) == ""), F.lit("/")).otherwise(F.array_join(prefix, "/"))
    return pairs.select("group", root.alias("root"))


def encoded_paths(df: DataFrame, group_col: str, order_col: str, path_col: str) -> DataFrame:
    """``encode`` for each group's paths in order: (group, encoded, n)."""
    part = F.concat(F.when(F.contains(F.col(path_col), F.lit("\0")), F.lit("")).otherwise(F.col(path_col)), F.lit("\0"))
    rows = df.select(F.col(group_col).alias("group"), F.col(order_col).alias("_order"), part.alias("_part")).filter("_part is not null")
    joined = F.expr("listagg(_part, '') within group (order by _order)")
    return rows.groupBy("group").agg(F.encode(joined, "UTF-8").alias("encoded"), F.count(F.lit(1)).alias("n"))


def ancestors(path: Column) -> Column:
    """Rows' directories from the nearest to the root: array of (depth, dir); explode it to walk upwards."""
    parts = segments(path)
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda d: F.struct(d.alias("depth"), F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - d), "/")).alias("dir")),
    )
