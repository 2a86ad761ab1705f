"""Registered queries that run over real files: every page's html as a file of a folder of its own, and their SQL twins.

Files are written once per call below the folder in ``spark.checkpoint.dir`` (a temporary one only where that is unset),
which has to be a path that all executors mount, as the file operators ask for anyway.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import compression, hashing
from .operators import compare
from .plans.manifest import Manifest
from .sources import files

_FOLDERS = 16


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    base = shared.removeprefix("file://").removeprefix("file:").rstrip("/") if shared else tempfile.mkdtemp(prefix="tallymark-")
    return f"{base}/files-{uuid.uuid4().hex}"


def _pages(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """(page_id, rel, path, html): the page's place below the folder and its content as bytes."""
    rel = F.concat((F.col("page_id") % _FOLDERS).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", rel.alias("rel"), F.concat(F.lit(root + "/"), rel).alias("path"), F.encode("html", "UTF-8").alias("html"))


def _write(pages: DataFrame) -> int:
    return files.write_decompressed(pages.select("path", F.octet_length("html").alias("uncompressed_size"), compression.lz4_block(F.col("html")).alias("data")))


def _written(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    root = _folder(spark)
    pages = _pages(spark, sf_dir, root)
    _write(pages)
    return root, pages


def _page_of(path: str = "path"):
    return F.regexp_extract(path, "(-?[0-9]+)[.]html$", 1).cast("long").alias("page_id")


def files_read(spark, sf_dir):
    """Files written from LZ4 blocks and read back whole."""
    root, _ = _written(spark, sf_dir)
    return files.read_contents(spark, root, glob="*.html").select(_page_of(), "length", F.md5("content").alias("digest"))


def files_stat(spark, sf_dir):
    """Stat of a folder's tree, and whether listed paths have the same stat and digest."""
    root, pages = _written(spark, sf_dir)
    spark.dataSource.register(files.FileStatSource)
    tree = spark.read.format("file_stat").option("hash", "true").load(root)
    listed = files.stat_paths(pages, with_hash=True)
    same = F.lit(True)
    for c in ("ino", "mtime_ns", "ctime_ns", "size", "content_hash"):
        same = same & (tree[c] == listed[c])
    return tree.join(listed, tree["path"] == listed["path"], "full_outer").select(_page_of(tree["path"]), tree["size"], same.alias("same"))


def files_digested(spark, sf_dir):
    """Digests of listed files, by ordinal, against those of the column; a file that isn't there has zeros."""
    _, pages = _written(spark, sf_dir)
    gone = pages.select((-F.col("page_id") - 1).alias("page_id"), F.concat("path", F.lit(".none")).alias("path"))
    found = files.digest_files(pages.select("page_id", "path").unionByName(gone), "zero", ordinal_col="page_id")
    want = pages.select(F.col("page_id").alias("ordinal"), hashing.to_hex(hashing.digest(F.col("html"))).alias("want"))
    zero = F.col("hex") == "0" * 32
    return found.join(want, "ordinal", "left").select(F.col("ordinal").alias("page_id"), zero.alias("zero"), F.coalesce(F.col("hex") == F.col("want"), F.lit(False)).alias("same"))


def files_compressed(spark, sf_dir):
    """Files read as LZ4 blocks."""
    root, _ = _written(spark, sf_dir)
    blocks = files.read_compressed(spark, f"{root}/*")
    back = compression.lz4_unblock(F.col("data"), F.col("uncompressed_size"))
    return blocks.select(_page_of(), "uncompressed_size", F.md5(back).alias("digest"))


def files_equal(spark, sf_dir):
    """Each page's file against the one of the page before, and against itself."""
    root, pages = _written(spark, sf_dir)
    before = F.col("page_id") - 1
    other = F.concat(F.lit(root + "/"), F.expr(f"pmod(page_id - 1, {_FOLDERS})").cast("string"), F.lit("/"), before.cast("string"), F.lit(".html"))
    pairs = pages.select("path", F.explode(F.array("path", other)).alias("other"))
    return compare.files_equal(pairs, "path", "other").select(_page_of("a"), _page_of("b").alias("other_id"), "equal")


def _edited(pages: DataFrame) -> DataFrame:
    return pages.filter("page_id % 7 = 3").withColumn("html", F.concat("html", F.encode(F.lit("~"), "UTF-8")))


def _manifest(spark, sf_dir):
    """A manifest of the files of all pages, and how to make it again with other settings."""
    root, pages = _written(spark, sf_dir)
    listed = [r["path"] for r in pages.select("path").toLocalIterator()]
    make = lambda **k: Manifest(spark, f"{root}-manifest", **({"files": listed, "root": root, "version": 1} | k))
    return root, pages, listed, make


def manifest_files(spark, sf_dir):
    """Every listed file's state after some were edited: changed, size, and whether its digest is the content's."""
    root, pages, _, make = _manifest(spark, sf_dir)
    make().overwrite()
    edited = _edited(pages)
    _write(edited)
    path = f"{root}-state"
    with make().open() as session:
        session.resolve().select("path", "size", "changed", "missing", "content_hash_hex").write.parquet(path)
    now = pages.join(edited.select("page_id", F.col("html").alias("new")), "page_id", "left")
    want = now.select(F.col("rel").alias("path"), "page_id", hashing.to_hex(hashing.digest(F.coalesce("new", "html"))).alias("want"))
    return spark.read.parquet(path).join(want, "path", "left").select("page_id", "size", "changed", "missing", (F.col("content_hash_hex") == F.col("want")).alias("same"))


def manifest_flow(spark, sf_dir):
    """The status of each opening in a manifest's life, and how many files the step found changed."""
    _, pages, listed, make = _manifest(spark, sf_dir)
    steps = []

    def opened(m, write=False):
        with m.open() as s:
            changed = s.resolve().filter("changed").count() if s.status in ("changed", "statsDirty") and not s.config_changed else 0
            steps.append((len(steps), s.status, changed, s.needs_write))
            if write:
                s.write()

    opened(make(), write=True)
    last = make()
    opened(last)
    opened(make(version=2))
    opened(make(fingerprint=b"f" * 16))
    opened(make(files=listed[:-1]))
    _write(pages)  # the same contents again
    opened(make())
    edited = _edited(pages)
    _write(edited)
    last.invalidate(*[p for p in listed if p.endswith("/1.html")])
    opened(last)  # only the file that was named, which has new stat alone
    opened(make(), write=True)
    opened(make())
    with make().locked():
        opened(make(lock_timeout_ms=0))
    return spark.createDataFrame(steps, "step int, status string, n_changed long, needs_write boolean").coalesce(1)


QUERIES = [files_read, files_stat, files_digested, files_compressed, files_equal, manifest_files, manifest_flow]

ORACLES = {
    "files_read": "SELECT page_id, strlen(html) AS length, md5(html) AS digest FROM pages",
    "files_stat": "SELECT page_id, strlen(html) AS size, true AS same FROM pages",
    "files_digested": "SELECT page_id, false AS zero, true AS same FROM pages UNION ALL SELECT -page_id - 1, true, false FROM pages",
    "files_compressed": "SELECT page_id, strlen(html) AS uncompressed_size, md5(html) AS digest FROM pages",
    "files_equal": """SELECT page_id, page_id AS other_id, true AS equal FROM pages
        UNION ALL SELECT a.page_id, a.page_id - 1, coalesce(a.html = b.html, false) FROM pages a LEFT JOIN pages b ON b.page_id = a.page_id - 1""",
    "manifest_files": """SELECT page_id, strlen(html) + CASE WHEN page_id % 7 = 3 THEN 1 ELSE 0 END AS size, page_id % 7 = 3 AS changed, false AS missing, true AS same
        FROM pages""",
    "manifest_flow": """WITH n AS (SELECT count(*) AS n FROM pages WHERE page_id % 7 = 3)
        SELECT step, status, n_changed, needs_write FROM (VALUES (0, 'missing', 0, true), (1, 'upToDate', 0, false), (2, 'staleVersion', 0, true), (3, 'stale', 0, true),
          (4, 'changed', 0, true), (5, 'statsDirty', 0, true), (6, 'statsDirty', -1, true), (7, 'changed', -1, true), (8, 'upToDate', 0, false), (9, 'lockFailed', 0, false))
          AS t(step, status, c, needs_write), (SELECT n FROM n) AS m(n), LATERAL (SELECT CASE WHEN c < 0 THEN n ELSE c END AS n_changed)""",
}


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
