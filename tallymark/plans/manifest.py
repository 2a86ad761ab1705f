"""A versioned manifest of files and the question it answers: what has changed since.

A snapshot is three Parquet tables (snapshot, entries, payloads) in a folder of its own; a pointer file names the
current one and changes by an atomic rename.  Checking compares stat columns by a full outer join and reads the content
of those files only whose stat differs at equal size.
"""

from __future__ import annotations

import fcntl
import json
import os
import posixpath
import shutil
import time
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, paths
from ..sources.files import STAT, stat_paths

MAX_FILES = 1_048_576
OK, STAT_DIRTY, CHANGED = 0, 1, 2
_STAT = ("ino", "mtime_ns", "ctime_ns", "size")
_ENTRIES = STAT + ", content_hash binary"
_STATUS = {OK: "upToDate", STAT_DIRTY: "statsDirty", CHANGED: "changed"}


def stat_verdict(old: str = "old", new: str = "new") -> Column:
    """OK, CHANGED, or null where the content must decide. ``old`` and ``new`` are struct columns with the stat fields."""
    same = F.lit(True)
    for f in _STAT:
        same = same & F.col(f"{old}.{f}").eqNullSafe(F.col(f"{new}.{f}"))
    return (
        F.when(F.col(f"{old}.path").isNull() | F.col(f"{new}.size").isNull(), CHANGED)
        .when(same, OK)
        .when(F.col(f"{old}.size") != F.col(f"{new}.size"), CHANGED)
    )


def diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change) with change = added, removed, changed or same, between two tables by a column of content digests."""
    a = old.select(F.col(key), F.col(content).alias("_old"), F.lit(1).alias("_a"))
    b = new.select(F.col(key), F.col(content).alias("_new"), F.lit(1).alias("_b"))
    change = (
        F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def status_of(changes: DataFrame) -> DataFrame:
    """(status) of a table with a column ``change``, as ``diff`` gives it."""
    return changes.agg(F.when(F.coalesce(F.max(F.col("change") != "same"), F.lit(False)), _STATUS[CHANGED]).otherwise(_STATUS[OK]).alias("status"))


def asked_only(rows: DataFrame, dirty: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in the dirty set."""
    return rows.join(dirty.select(key).distinct(), key, "left_semi")


def remap(old: DataFrame, new_paths: DataFrame) -> DataFrame:
    """The new path list with the old entries where paths agree."""
    return new_paths.select("path").join(old, "path", "left")


class Manifest:
    """A manifest at ``folder``: configure, open, resolve, write, overwrite, invalidate."""

    def __init__(
        self, spark: SparkSession, folder: str, files: Sequence[str] | None = None, root: str | None = None, version: int = 0,
        fingerprint: bytes | None = None, lock_timeout_ms: int = -1, force_hash: bool = False,
    ):
        self.spark, self.folder = spark, folder
        self.lock_timeout_ms, self.force_hash = lock_timeout_ms, force_hash
        self._dirty: set[str] | None = None  # None: all
        self._root = self._files = None
        self._seen: str | None = None
        self.configure(files=files, root=root, version=version, fingerprint=fingerprint)

    def configure(self, **changes) -> None:
        for name in changes.keys() - {"files", "root", "version", "fingerprint"}:
            raise TypeError(f"unknown setting {name}")
        if "fingerprint" in changes:
            f = changes["fingerprint"]
            if f is not None and len(f) != 16:
                raise TypeError("a fingerprint has 16 bytes")
            self.fingerprint = None if f is None or f == bytes(16) else bytes(f)
        if "version" in changes:
            self.version = changes["version"] & 0xFFFFFFFF
        if "root" in changes or "files" in changes:
            files = changes.get("files", self._files)
            root = changes.get("root") or self._root or (paths.common_root(files, base=os.getcwd()) if files else "/") or "/"
            if root != self._root:
                self._dirty = None
            self._root = root
            self._files = None if files is None else paths.normalized(root, files)
            if self._files and len(self._files) > MAX_FILES:
                raise ValueError("too many files for one manifest")

    def invalidate(self, *changed: str) -> None:
        """Only these paths (and earlier ones) are checked at the next opening; ignored while all are."""
        if self._dirty is not None:
            self._dirty |= set(paths.normalized(self._root, changed))

    def invalidate_all(self) -> None:
        self._dirty = None

    # -- storage

    def _pointer(self) -> dict | None:
        try:
            with open(f"{self.folder}/current.json", encoding="utf-8") as f:
                p = json.load(f)
            return p if os.path.isdir(f"{self.folder}/{p['id']}") else None
        except (OSError, ValueError, KeyError, TypeError):
            return None

    def changed_on_disk(self) -> bool:
        """Whether another snapshot is current than the one last opened or written here."""
        now = self._pointer()
        return self._seen is None or now is None or now["id"] != self._seen

    def _entries(self, pointer: dict) -> DataFrame:
        return self.spark.read.schema(_ENTRIES).parquet(f"{self.folder}/{pointer['id']}/entries")

    def payloads(self, kind: str) -> list[bytes]:
        """Stored blobs in order; kind is compressed or uncompressed (a hint only: Parquet's codec serves both)."""
        p = self._pointer()
        if p is None:
            return []
        rows = self.spark.read.parquet(f"{self.folder}/{p['id']}/payloads").filter(F.col("kind") == kind).orderBy("ordinal")
        return [bytes(r["data"]) for r in rows.select("data").collect()]

    @contextmanager
    def locked(self):
        """The manifest's lock; yields False if it can't be had in time (-1 waits, 0 tries once)."""
        os.makedirs(self.folder, exist_ok=True)
        with open(f"{self.folder}/lock", "a") as f:
            yield _locked(f, self.lock_timeout_ms)

    def is_locked(self) -> bool:
        if not os.path.exists(f"{self.folder}/lock"):
            return False
        with open(f"{self.folder}/lock", "a") as f:
            return not _locked(f, 0)

    def wait_unlocked(self, timeout_ms: int = -1) -> bool:
        if not os.path.exists(f"{self.folder}/lock"):
            return True
        with open(f"{self.folder}/lock", "a") as f:
            return _locked(f, timeout_ms)

    # -- checking

    @property
    def needs_open(self) -> bool:
        """Whether an opening can tell more than the last one did."""
        return self._dirty is None or bool(self._dirty) or self.changed_on_disk()

    def open(self) -> "Session":
        """Status and the means to resolve and write; the session holds the lock until it writes or is closed.

        First match decides, from the lock to the files themselves.
        """
        os.makedirs(self.folder, exist_ok=True)
        lock = open(f"{self.folder}/lock", "a")
        if not _locked(lock, self.lock_timeout_ms):
            lock.close()
            return Session(self, "lockFailed", None)
        try:
            session = self._opened()
        except BaseException:
            lock.close()
            raise
        session._lock = lock
        return session

    def _opened(self) -> "Session":
        pointer = self._pointer()
        self._seen = pointer and pointer["id"]
        if pointer is None:
            return Session(self, "missing", None)
        if self._files is None:  # reuse the stored list
            self._root = pointer["root_path"] if self._root in (None, "/") else self._root
        if pointer["version"] != self.version:
            return Session(self, "staleVersion", pointer)
        stored = bytes.fromhex(pointer["fingerprint"]) if pointer["fingerprint"] else None
        if stored != self.fingerprint:
            return Session(self, "stale", pointer)
        if (pointer["file_count"] if self._files is None else len(self._files)) == 0:
            return Session(self, "upToDate", pointer)
        if self._files is not None and self._paths_digest(self._files) != pointer["paths_digest"]:
            return Session(self, "changed", pointer)
        if self._dirty is not None and not self._dirty:
            return Session(self, "upToDate", pointer)
        session = Session(self, "", pointer)
        worst = session.verdicts(only=self._dirty).agg(F.max("severity")).first()[0]
        session.status = _STATUS[worst or OK]
        if session.status == "upToDate":
            self._dirty = set()
        return session

    @staticmethod
    def _paths_digest(files: Sequence[str]) -> str:
        import xxhash

        return xxhash.xxh3_128_hexdigest(paths.encode(files))

    def overwrite(self, **payload) -> str:
        """A fresh snapshot without reading the old one; payloads and values not given are empty and 0."""
        if self._files is None:
            raise ValueError("overwriting needs a file list")
        with self.locked() as held:
            return self._save(self._fresh(self._files), self._files, **payload) if held else "lockFailed"

    def _fresh(self, files: Sequence[str]) -> DataFrame:
        listed = self.spark.createDataFrame([(posixpath.join(self._root, p), p) for p in files], "full string, rel string")
        found = stat_paths(listed, "full", with_hash=True)
        rel = listed.join(found, listed["full"] == found["path"])
        return rel.select(F.col("rel").alias("path"), *_STAT, F.coalesce("content_hash", hashing.zero_digest()).alias("content_hash"))

    def _save(self, entries: DataFrame, files: Sequence[str], values=(0.0, 0.0, 0.0, 0.0), compressed=(), uncompressed=()) -> str:
        name = uuid.uuid4().hex
        base = f"{self.folder}/{name}"
        entries.coalesce(max(1, len(files) // 100_000)).write.parquet(f"{base}/entries")
        blobs = [("compressed", i, bytes(d)) for i, d in enumerate(compressed)] + [("uncompressed", i, bytes(d)) for i, d in enumerate(uncompressed)]
        self.spark.createDataFrame(blobs, "kind string, ordinal int, data binary").coalesce(1).write.parquet(f"{base}/payloads")
        head = {
            "id": name, "root_path": self._root, "version": self.version, "fingerprint": self.fingerprint.hex() if self.fingerprint else None,
            "file_count": len(files), "paths_digest": self._paths_digest(files), "values": [float(v) for v in values],
        }
        old = self._pointer()
        head["previous"] = old and old["id"]  # rows resolved from it may still be read
        part = f"{self.folder}/.{name}"
        with open(part, "w", encoding="utf-8") as f:
            json.dump(head, f)
        os.replace(part, f"{self.folder}/current.json")
        if old is not None and old.get("previous"):
            shutil.rmtree(f"{self.folder}/{old['previous']}", ignore_errors=True)
        self._seen, self._dirty = name, set()
        return "written"


class Session:
    """What one opening found. ``resolve`` gives every file's state, ``write`` stores them once."""

    def __init__(self, manifest: Manifest, status: str, pointer: dict | None):
        self._m, self.status, self._pointer = manifest, status, pointer
        self._resolved: DataFrame | None = None
        self._verdicts: DataFrame | None = None
        self._closed = False
        self._lock = None
        self._scans: list[str] = []

    @property
    def values(self) -> list[float]:
        return self._pointer["values"] if self._pointer else [0.0] * 4

    @property
    def needs_write(self) -> bool:
        return self.status not in ("upToDate", "lockFailed")

    @property
    def config_changed(self) -> bool:
        """Whether version, fingerprint or the list of files differ from what is stored."""
        m, p = self._m, self._pointer
        if p is None:
            return True
        stored = bytes.fromhex(p["fingerprint"]) if p["fingerprint"] else None
        listed = m._files is None or m._paths_digest(m._files) == p["paths_digest"]
        return p["version"] != m.version or stored != m.fingerprint or not listed

    def find(self, path: str):
        """The resolved row of one file, by its path below the root or a full one; None if it isn't listed."""
        rel = paths.relative(self._m._root, path)
        return self.resolve().filter(F.col("path") == rel).first() if rel else None

    def _once(self, rows: DataFrame) -> DataFrame:
        """Rows written beside the snapshots, so that every use sees one and the same look at the files."""
        path = f"{self._m.folder}/.scan-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self._scans.append(path)
        return self._m.spark.read.schema(rows.schema).parquet(path)

    def files(self) -> list[str]:
        if self._m._files is not None:
            return self._m._files
        if self._pointer is None:
            return []
        return [r["path"] for r in self._m._entries(self._pointer).select("path").orderBy("path").collect()]

    def verdicts(self, only: set[str] | None = None) -> DataFrame:
        """(path, old, new, severity, content_hash): stat first, then content where stat differs at equal size.

        Each file is looked at once in a session: what was found is written and read again.
        """
        if only is None and self._verdicts is not None:
            return self._verdicts
        m, spark = self._m, self._m.spark
        listed = spark.createDataFrame([(p,) for p in self.files()], "path string")
        old = m._entries(self._pointer) if self._pointer else spark.createDataFrame([], _ENTRIES)
        if only is not None:
            listed = asked_only(listed, spark.createDataFrame([(p,) for p in only], "path string"), "path")
        prefix = m._root if m._root.endswith("/") else m._root + "/"
        full = listed.select(F.concat(F.lit(prefix), F.col("path")).alias("path"))
        now = stat_paths(full).withColumn("path", F.expr(f"substring(path, {len(prefix) + 1})"))
        both = (
            now.select("path", F.struct("path", *_STAT).alias("new"))
            .join(old.select("path", F.struct("path", *_STAT, "content_hash").alias("old")), "path", "left")
            .withColumn("severity", F.lit(None).cast("int") if m.force_hash else stat_verdict())
        )
        both = self._once(both)
        settled = both.filter("severity is not null").withColumn("content_hash", F.when(F.col("severity") == OK, F.col("old.content_hash")))
        asked = both.filter("severity is null")
        hashed = stat_paths(asked.select(F.concat(F.lit(prefix), F.col("path")).alias("path")), with_hash=True)
        hashed = hashed.select(F.expr(f"substring(path, {len(prefix) + 1})").alias("path"), "content_hash")
        asked = asked.drop("severity").join(hashed, "path", "left").withColumn(
            "severity",
            F.when(F.col("content_hash").eqNullSafe(F.col("old.content_hash")), STAT_DIRTY if not m.force_hash else OK).otherwise(CHANGED),
        )
        rows = self._once(settled.unionByName(asked))
        if only is None:
            self._verdicts = rows
        return rows

    def resolve(self) -> DataFrame:
        """(path, size, mtime_ns, ctime_ns, ino, changed, missing, content_hash, content_hash_hex) of all files, ordered."""
        if self._closed:
            raise RuntimeError("the session is closed")
        if self._resolved is None:
            rows = self.verdicts()
            prefix = self._m._root if self._m._root.endswith("/") else self._m._root + "/"
            need = rows.filter("content_hash is null and new.size is not null")
            extra = stat_paths(need.select(F.concat(F.lit(prefix), F.col("path")).alias("path")), with_hash=True)
            extra = extra.select(F.expr(f"substring(path, {len(prefix) + 1})").alias("path"), F.col("content_hash").alias("more"))
            value = F.coalesce("content_hash", "more", hashing.zero_digest())
            resolved = (
                rows.join(extra, "path", "left")
                .select(
                    "path", *[F.col(f"new.{f}").alias(f) for f in _STAT], (F.col("severity") == CHANGED).alias("changed"),
                    F.col("new.size").isNull().alias("missing"), value.alias("content_hash"), hashing.to_hex(value).alias("content_hash_hex"),
                )
            )
            self._resolved = self._once(resolved).orderBy("path")
        return self._resolved

    def write(self, **payload) -> str:
        """Store the present state; payloads and values not given stay, None empties them."""
        if self._closed:
            raise RuntimeError("the session is closed")
        if self.status == "lockFailed":
            return "lockFailed"
        kept = {
            "values": self.values,
            "compressed": self._m.payloads("compressed") if "compressed" not in payload else (),
            "uncompressed": self._m.payloads("uncompressed") if "uncompressed" not in payload else (),
        }
        given = {k: v if v is not None else ((0.0,) * 4 if k == "values" else ()) for k, v in payload.items()}
        entries = self.resolve().select("path", *_STAT, "content_hash")
        done = self._m._save(entries, self.files(), **(kept | given))
        self._release()
        return done

    def close(self) -> None:
        if not self._closed and self.status not in ("upToDate", "lockFailed"):
            self._m.invalidate_all()
        self._release()

    def _release(self) -> None:
        self._closed = True
        for path in self._scans:
            shutil.rmtree(path, ignore_errors=True)
        if self._lock is not None:
            self._lock.close()
            self._lock = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def _locked(f, timeout_ms: int) -> bool:
    if timeout_ms < 0:
        fcntl.flock(f, fcntl.LOCK_EX)
        return True
    until, wait = time.monotonic() + timeout_ms / 1000, 0.001
    while True:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            return True
        except OSError:
            if time.monotonic() >= until:
                return False
            time.sleep(wait)
            wait = min(wait * 2, 0.025)
