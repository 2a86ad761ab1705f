"""File scans: content, nanosecond stat, stat with digest, and LZ4 in and out."""

from __future__ import annotations

import os
import stat as stat_of
import tempfile

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import compression, hashing

STAT = "path string, ino long, mtime_ns long, ctime_ns long, size long"
_INO_BITS = (1 << 61) - 1
MAX_FILE = 512 << 20


def read_contents(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """(path, length, content) of files; content is only read if it is used, a filter on length reaches the scan."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return reader.load(list(paths)).select("path", "length", "content")


def stat_row(path: str) -> tuple | None:
    """Stat of a regular file, symbolic links followed; None if there is none."""
    try:
        s = os.stat(path)
    except (OSError, ValueError):
        return None
    if not stat_of.S_ISREG(s.st_mode):
        return None
    return (path, s.st_ino & _INO_BITS, s.st_mtime_ns, s.st_ctime_ns, s.st_size)


def _hash_open(f, seed: int, chunk: int = 1 << 20) -> bytes:
    state = xxhash.xxh3_128(seed=seed)
    while data := f.read(chunk):
        state.update(data)
    return state.digest()


def hash_file(path: str, seed: int = 0) -> bytes | None:
    """A file's digest read in chunks, so size doesn't matter; None if it can't be read."""
    try:
        with open(path, "rb") as f:
            return _hash_open(f, seed)
    except (OSError, ValueError):
        return None


def stat_and_hash(path: str) -> tuple | None:
    """``stat_row`` and the digest of one and the same opened file; the digest is None if only stat can be had."""
    try:
        # a pipe doesn't hold the opening up
        with os.fdopen(os.open(path, os.O_RDONLY | os.O_NONBLOCK | os.O_CLOEXEC), "rb") as f:
            s = os.fstat(f.fileno())
            if not stat_of.S_ISREG(s.st_mode):
                return None
            return (path, s.st_ino & _INO_BITS, s.st_mtime_ns, s.st_ctime_ns, s.st_size, _hash_open(f, 0))
    except (OSError, ValueError):
        row = stat_row(path)
        return row and (*row, None)


class FileStatSource(DataSource):
    """``spark.read.format("file_stat").load(directory)``: nanosecond stat rows of a tree, a task per top directory.

    Option ``hash`` = true adds the content's digest, read in the same pass.
    """

    @classmethod
    def name(cls) -> str:
        return "file_stat"

    def schema(self) -> str:
        return STAT + (", content_hash binary" if self.options.get("hash", "false").lower() == "true" else "")

    def reader(self, schema) -> "FileStatReader":
        return FileStatReader(self.options["path"], self.options.get("hash", "false").lower() == "true")


class FileStatReader(DataSourceReader):
    def __init__(self, root: str, with_hash: bool):
        self._root, self._with_hash = root, with_hash

    def partitions(self):
        top = [self._root]
        with os.scandir(self._root) as entries:
            top += sorted(e.path for e in entries if e.is_dir())
        return [InputPartition((p, p != self._root)) for p in top]

    def read(self, partition):
        root, deep = partition.value
        for folder, folders, names in os.walk(root):
            if not deep:
                folders.clear()
            folders.sort()
            for name in sorted(names):
                row = (stat_and_hash if self._with_hash else stat_row)(os.path.join(folder, name))
                if row is not None:
                    yield row


def stat_paths(paths: DataFrame, path_col: str = "path", with_hash: bool = False) -> DataFrame:
    """Stat (and digest) of listed paths; those that can't be read have nulls. Each file is opened once, in its task."""
    import pyarrow as pa

    schema = STAT + (", content_hash binary" if with_hash else "")

    def run(batches):
        for b in batches:
            listed = b.column(0).to_pylist()
            look = stat_and_hash if with_hash else stat_row
            rows = [look(p) if p else None for p in listed]
            columns = [pa.array(listed, pa.string())] + [pa.array([r and r[i] for r in rows], pa.int64()) for i in range(1, 5)]
            names = ["path", "ino", "mtime_ns", "ctime_ns", "size"]
            if with_hash:
                columns.append(pa.array([r and r[5] for r in rows], pa.binary()))
                names.append("content_hash")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return paths.select(paths[path_col].cast("string").alias("path")).mapInArrow(run, schema)


def digest_files(paths: DataFrame, on_error: str = "fail", path_col: str = "path", ordinal_col: str | None = None) -> DataFrame:
    """(ordinal, path, digest, hex) of listed files; ``on_error``: fail, zero (16 zero bytes) or skip."""
    if on_error not in ("fail", "zero", "skip"):
        raise ValueError("on_error is fail, zero or skip")
    import pyarrow as pa

    listed = paths.select((paths[ordinal_col] if ordinal_col else F.lit(0)).cast("long").alias("ordinal"), paths[path_col].cast("string").alias("path"))

    def run(batches):
        for b in batches:
            found = [hash_file(p) if p else None for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], names=["ordinal", "path", "digest"])

    out = listed.mapInArrow(run, "ordinal long, path string, digest binary")
    if on_error == "skip":
        out = out.filter("digest is not null")
    else:
        other = hashing.zero_digest() if on_error == "zero" else F.raise_error(F.concat(F.lit("can't read "), F.coalesce("path", F.lit("null")))).cast("binary")
        out = out.withColumn("digest", F.coalesce("digest", other))
    return out.withColumn("hex", hashing.to_hex(F.col("digest")))


def read_compressed(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, uncompressed_size, data): files as LZ4 blocks, up to 512 MiB each; empty files are empty."""
    files = read_contents(spark, *paths)
    fits = F.when(F.col("length") <= MAX_FILE, F.col("content")).otherwise(F.raise_error(F.lit("file is too large")).cast("binary"))
    packed = files.select("path", F.col("length").alias("uncompressed_size"), compression.lz4_block(fits).alias("data"))
    # the file scan leaves out files without content
    listed = stat_paths(spark.createDataFrame([(p,) for p in paths], "path string")).filter("size = 0")
    empty = listed.select(F.concat(F.lit("file:"), F.col("path")).alias("path"), F.col("size").alias("uncompressed_size"), F.lit(b"").alias("data"))
    return packed.filter("uncompressed_size > 0").unionByName(empty)


def write_decompressed(blocks: DataFrame) -> int:
    """Write (path, uncompressed_size, data) rows as files and return how many.

    A block is decompressed before its file is touched; folders are made; a file appears whole, by a rename, so a task
    that runs again changes nothing.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for path, size, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                content = compression.decompress(data.as_py(), size)
                os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                fd, part = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
                with os.fdopen(fd, "wb") as f:
                    f.write(content)
                os.replace(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return blocks.select("path", F.col("uncompressed_size").cast("long"), "data").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
