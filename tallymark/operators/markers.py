"""Project markers along parent directories.

``walk`` and ``walk_nearest`` answer for one start on the driver's file system.  ``project_roots`` answers for a table
of starts against a table of marker paths: each start's directories are exploded with their depth and meet the markers
in one equi-join; nearest and outermost are then a minimum and a maximum by depth.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors

MAX_DEPTH = 128
# Lock files, the first wins a tie of modification times.
LOCKFILES = ("pnpm-lock.yaml", "yarn.lock", "package-lock.json")
_FIELDS = {"package.json": "PackageJson", "tsconfig.json": "Tsconfig", "node_modules": "NodeModules"}


def _start(path: str) -> str:
    if not path:
        raise ValueError("a start path is needed")
    path = os.path.realpath(path)
    while not os.path.exists(path) and path != "/":
        path = os.path.dirname(path)
    return path if os.path.isdir(path) else os.path.dirname(path)


def _folders(start: str, home: str | None, stop: str | None):
    """Directories upwards; the walk ends before home, the stop path, and whatever holds either."""
    bounds = [os.path.realpath(b) for b in (home, stop) if b]
    folder = _start(start)
    for _ in range(MAX_DEPTH):
        if any(b == folder or b.startswith(folder.rstrip("/") + "/") for b in bounds):
            return
        yield folder
        if folder == "/":
            return
        folder = os.path.dirname(folder)


def _found(folder: str, name: str) -> str | None:
    if name == "node_modules" and os.path.basename(folder) == name:
        return folder
    path = os.path.join(folder, name)
    fits = os.path.isdir(path) if name == "node_modules" else os.path.isfile(path)
    return path if fits else None


def walk_nearest(start: str, home: str | None = None, stop: str | None = None) -> dict[str, str | None]:
    """The first package.json, tsconfig.json and node_modules upwards, not above the innermost git root."""
    out: dict[str, str | None] = {f"nearest{f}": None for f in _FIELDS.values()}
    for folder in _folders(start, home or str(Path.home()), stop):
        for name, field in _FIELDS.items():
            out[f"nearest{field}"] = out[f"nearest{field}"] or _found(folder, name)
        if all(out.values()) or os.path.exists(os.path.join(folder, ".git")):
            break
    return out


def walk(start: str, home: str | None = None, stop: str | None = None) -> dict[str, str | None]:
    """The nine project paths of a start: git roots, nearest and outermost markers, and the root's lock file.

    Markers above the innermost git root belong to another project and don't count; a lock file is looked for beside
    the outermost package.json only.
    """
    out: dict[str, str | None] = {"gitRoot": None, "gitSuperRoot": None}
    out |= {f"{k}{f}": None for k in ("nearest", "root") for f in _FIELDS.values()} | {"rootLockfile": None}
    for folder in _folders(start, home or str(Path.home()), stop):
        if out["gitRoot"] is None:
            for name, field in _FIELDS.items():
                found = _found(folder, name)
                if found:
                    out[f"nearest{field}"] = out[f"nearest{field}"] or found
                    out[f"root{field}"] = found
        git = os.path.join(folder, ".git")
        if os.path.exists(git):
            out["gitRoot"] = out["gitRoot"] or folder
            if os.path.isdir(git):
                out["gitSuperRoot"] = folder
    if out["gitSuperRoot"] == out["gitRoot"]:
        out["gitSuperRoot"] = None
    if out["rootPackageJson"]:
        root = os.path.dirname(out["rootPackageJson"])
        locks = [(os.stat(p).st_mtime_ns, -i, p) for i, n in enumerate(LOCKFILES) if os.path.isfile(p := os.path.join(root, n))]
        out["rootLockfile"] = max(locks)[2] if locks else None
    return out


def project_roots(starts: DataFrame, inventory: DataFrame, start_col: str = "start", home: str | None = None, stop: str | None = None) -> DataFrame:
    """(start, git_root, git_super_root, nearest_*, root_*, root_lockfile) of starting directories.

    ``inventory`` has (path, kind, mtime_ns) with kind file or dir.  The rules are those of ``walk``: markers count up to
    the innermost git root, and folders that are or hold ``home`` or ``stop`` end the walk.  A start may be a file or
    lack in the inventory: the folders above it are looked at all the same.
    """
    marks = inventory.select(
        F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "path", "kind", "mtime_ns"
    ).withColumn("dir", F.when(F.col("dir") == "", "/").otherwise(F.col("dir")))
    wanted = F.when(F.col("name") == "node_modules", F.col("kind") == "dir").when(F.col("name") == ".git", F.lit(True)).otherwise(F.col("kind") == "file")
    marks = marks.filter(F.col("name").isin(*_FIELDS, ".git", *LOCKFILES)).filter(wanted)
    up = starts.select(starts[start_col].alias("start")).distinct().select("start", F.explode(ancestors(F.col("start"))).alias("a"))
    up = up.select("start", F.col("a.depth").alias("depth"), F.col("a.dir").alias("dir")).filter(F.col("depth") < MAX_DEPTH)
    for bound in (b.rstrip("/") for b in (home, stop) if b):
        up = up.filter(~F.startswith(F.lit(bound + "/"), F.concat(F.rtrim("dir", F.lit("/")), F.lit("/"))))
    own = up.filter(F.col("dir").endswith("/node_modules")).select(
        "dir", "start", "depth", F.lit("node_modules").alias("name"), F.col("dir").alias("path"), F.lit("dir").alias("kind"), F.lit(0).cast("long").alias("mtime_ns")
    )  # a folder of that name is one itself, and none is looked for inside it
    inside = (F.col("name") == "node_modules") & F.col("dir").endswith("/node_modules")
    met = up.join(marks, "dir").select(*own.columns).filter(~inside).unionByName(own)
    is_git = F.col("name") == ".git"
    git = met.filter(is_git).groupBy("start").agg(
        F.min("depth").alias("git_depth"),
        F.min_by("dir", "depth").alias("git_root"),
        F.max_by(F.when(F.col("kind") == "dir", F.col("dir")), F.when(F.col("kind") == "dir", F.col("depth"))).alias("git_super_root"),
    )
    seen = met.filter(~is_git).join(git.select("start", "git_depth"), "start", "left")
    below = F.col("git_depth").isNull() | (F.col("depth") <= F.col("git_depth"))
    columns = []
    for name, field in (("package.json", "package_json"), ("tsconfig.json", "tsconfig"), ("node_modules", "node_modules")):
        here = F.col("name") == name
        columns += [
            F.min_by(F.when(here & below, F.col("path")), F.when(here & below, F.col("depth"))).alias(f"nearest_{field}"),
            F.max_by(F.when(here & below, F.col("path")), F.when(here & below, F.col("depth"))).alias(f"root_{field}"),
        ]
    found = seen.groupBy("start").agg(*columns)
    base = starts.select(starts[start_col].alias("start")).distinct().join(found, "start", "left").join(git.drop("git_depth"), "start", "left")
    beside = F.regexp_replace("root_package_json", "/[^/]*$", "")
    base = base.withColumn("_root", F.when(beside == "", "/").otherwise(beside))
    order = F.struct("mtime_ns", *[(F.col("name") == n).alias(f"is_{i}") for i, n in enumerate(LOCKFILES)])
    locks = marks.filter(F.col("name").isin(*LOCKFILES)).groupBy(F.col("dir").alias("_root")).agg(F.max_by("path", order).alias("root_lockfile"))
    return base.join(locks, "_root", "left").drop("_root").withColumn(
        "git_super_root", F.when(F.col("git_super_root") != F.col("git_root"), F.col("git_super_root"))
    )
