"""The registered queries of the fingerprinting engine over the driver's tables, and their SQL twins.

``documents`` stands for files (doc_id the path, text the content), ``pages`` for paths, ``conversations`` for ordered
groups.  XXH3 and LZ4 are not in DuckDB: plans are checked with md5 there, the digests themselves by golden values.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import compression, hashing, paths
from .operators import compare, digests, markers
from .plans import manifest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents, and a later state: some gone, some edited, some new."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    later = docs.filter("doc_id % 7 <> 0").withColumn("text", F.when(F.expr("doc_id % 5 = 0"), F.concat("text", F.lit("~"))).otherwise(F.col("text")))
    added = docs.filter("doc_id % 11 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "text")
    digest = F.md5(F.encode("text", "UTF-8")).alias("digest")
    return docs.select("doc_id", digest), later.unionByName(added).select("doc_id", digest)


_SNAPSHOTS = """
a AS (SELECT doc_id, md5(text) AS digest FROM documents),
b AS (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '~' ELSE text END) AS digest FROM documents WHERE doc_id % 7 <> 0
      UNION ALL SELECT doc_id + 1000000000, md5(text) FROM documents WHERE doc_id % 11 = 0),
d AS (SELECT doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed'
      WHEN a.digest IS NOT DISTINCT FROM b.digest THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b USING (doc_id))
"""


def manifest_diff(spark, sf_dir):
    return manifest.diff(*_snapshots(spark, sf_dir), "doc_id", "digest")


def manifest_summary(spark, sf_dir):
    return manifest_diff(spark, sf_dir).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def manifest_status(spark, sf_dir):
    return manifest.status_of(manifest_diff(spark, sf_dir))


def manifest_remap(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    path = F.col("doc_id").cast("string").alias("path")
    out = manifest.remap(old.select(path, "digest"), new.select(path))
    return out.select("path", F.col("digest").isNotNull().alias("inherited"), F.col("digest").alias("old_digest"))


def manifest_dirty(spark, sf_dir):
    return manifest.asked_only(manifest_diff(spark, sf_dir), _table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id")


def stat_verdicts(spark, sf_dir):
    """Stat-first verdicts over orders as files: their date as mtime, their price as size."""
    o = _table(spark, sf_dir, "orders")
    key, size = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    stat = lambda mtime, size: F.struct(key.cast("string").alias("path"), key.alias("ino"), mtime.cast("long").alias("mtime_ns"), F.lit(0).cast("long").alias("ctime_ns"), size.alias("size"))
    rows = o.select(
        key,
        stat(F.lit(1), size).alias("old"),
        stat(F.when(key % 3 == 0, 2).otherwise(1), F.when(key % 6 == 0, size + 1).when(key % 10 == 0, F.lit(None)).otherwise(size)).alias("new"),
    )
    verdict = manifest.stat_verdict()
    return rows.select("o_orderkey", F.when(verdict == 0, "ok").when(verdict == 2, "changed").otherwise("read").alias("verdict"))


def content_dedup(spark, sf_dir):
    return compare.repeated_contents(_table(spark, sf_dir, "documents"), "doc_id", F.md5(F.encode("text", "UTF-8")))


def digest_of_digests_md5(spark, sf_dir):
    """The digest of digests with md5 in place of XXH3."""
    c = _table(spark, sf_dir, "conversations")
    md5 = lambda data: F.unhex(F.md5(data))
    return digests.digest_of_digests(c, ["conv_id"], "turn", F.encode("text", "UTF-8"), "zero", row_digest=md5, state=hashlib.md5).select("conv_id", "n", "hex")


def digest_of_digests(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    return digests.digest_of_digests(c, ["conv_id"], "turn", F.encode("text", "UTF-8"), "zero").select("conv_id", "n", "hex")


def digest_concat(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    return digests.digest_concat(c, ["conv_id"], "turn", F.encode("text", "UTF-8")).select("conv_id", "n", "hex")


def digest_concat_md5(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    return digests.digest_concat(c, ["conv_id"], "turn", F.encode("text", "UTF-8"), state=hashlib.md5).select("conv_id", "n", "hex")


def digest_strings(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", hashing.to_hex(hashing.digest_string(F.col("text"))).alias("hex"))


def digest_page_ranges(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    html = F.encode("html", "UTF-8")
    part = lambda *bounds: hashing.to_hex(hashing.digest_range(html, *bounds))
    return p.select("page_id", part(0, 16).alias("hex"), part(16).alias("rest"))  # the two make up the whole page


def hex_digests(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("d"))
    return d.select(
        "doc_id", hashing.to_hex(F.col("d")).alias("hex"), hashing.to_hex(F.col("d"), 1).alias("short"),
        F.array_join(hashing.to_hex_array(F.concat("d", "d")), ",").alias("pair"), F.size(hashing.to_hex_array(F.substring("d", 1, 15))).alias("n_bad"),
    )


def values_equal(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "text")
    other = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("other"))
    return d.join(other, "doc_id", "left").select("doc_id", compare.same_bytes(F.encode("text", "UTF-8"), F.encode("other", "UTF-8")).alias("equal"))


def lz4_bounds(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", compression.lz4_bound(F.octet_length("text")).alias("bound"))


def lz4_round_trip(spark, sf_dir):
    raw = F.encode("text", "UTF-8")
    d = _table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    d = d.withColumn("block", compression.lz4_block(F.col("raw"))).withColumn("back", compression.lz4_unblock(F.col("block"), F.octet_length("raw")))
    fits = F.octet_length("block") <= compression.lz4_bound(F.octet_length("raw"))
    return d.select("doc_id", (F.col("back") == F.col("raw")).alias("same"), fits.alias("fits"))


def _page_paths(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://", "")).alias("path"))


_PAGE_PATHS = "p AS (SELECT page_id, '/' || regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"


def paths_safe(spark, sf_dir):
    p = _page_paths(spark, sf_dir)
    return p.select("page_id", paths.is_safe(F.col("path")).alias("absolute_safe"), paths.is_safe(F.expr("substring(path, 2)")).alias("relative_safe"))


def paths_relative(spark, sf_dir):
    p = _page_paths(spark, sf_dir)
    dotted = F.concat(F.lit("/x/./y/.."), F.col("path"))
    return p.select("page_id", paths.relative_column("/x", dotted).alias("rel"), paths.relative_column("/other", F.col("path")).alias("outside"))


def paths_normalized(spark, sf_dir):
    return paths.normalized_paths(_page_paths(spark, sf_dir).select(F.concat(F.lit("/r"), F.regexp_replace("path", "[0-9]+", "n")).alias("path")), "/r")


def paths_common_root(spark, sf_dir):
    p = _page_paths(spark, sf_dir).withColumn("lang_group", F.col("page_id") % 13)
    return paths.common_roots(p.select(F.col("lang_group"), F.concat(F.lit("/srv/"), F.expr("cast(lang_group % 2 as string)"), "path").alias("path")), "lang_group", "path")


def paths_encoded(spark, sf_dir):
    p = _page_paths(spark, sf_dir).withColumn("g", F.col("page_id") % 17)
    return paths.encoded_paths(p, "g", "page_id", "path").select(F.col("group").alias("g"), F.md5("encoded").alias("digest"), "n")


def ancestor_dirs(spark, sf_dir):
    p = _page_paths(spark, sf_dir)
    return p.select("page_id", F.explode(paths.ancestors(F.col("path"))).alias("a")).select("page_id", "a.depth", "a.dir")


def _markers(spark, sf_dir):
    """Starts and markers made from supplier keys: a tree of three levels with markers at some of its folders."""
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    home = F.concat(F.lit("/w/g"), (F.col("k") % 5).cast("string"))
    mid = F.concat(home, F.lit("/p"), (F.col("k") % 20).cast("string"))
    starts = s.select(F.concat(mid, F.lit("/s"), F.col("k").cast("string")).alias("start"))
    mark = lambda where, folder, name, kind: s.filter(where).select(F.concat(folder, F.lit("/" + name)).alias("path"), F.lit(kind).alias("kind"), (F.col("k") % 5).alias("mtime_ns"))
    inventory = (
        mark("k % 5 < 3", home, ".git", "dir")
        .unionByName(mark("k % 20 = 3", mid, ".git", "file"))
        .unionByName(mark("k % 20 in (6, 11)", mid, ".git", "dir"))
        .unionByName(mark("k % 5 < 4", home, "package.json", "file"))
        .unionByName(mark("k % 20 < 9", mid, "package.json", "file"))
        .unionByName(mark("k % 5 = 0", home, "tsconfig.json", "file"))
        .unionByName(mark("k % 20 between 5 and 12", mid, "tsconfig.json", "file"))
        .unionByName(mark("k % 5 = 1", home, "node_modules", "dir"))
        .unionByName(mark("k % 20 in (1, 6)", mid, "node_modules", "dir"))
        .unionByName(mark("k % 5 in (1, 2, 4)", home, "yarn.lock", "file"))
        .unionByName(mark("k % 5 = 2", home, "pnpm-lock.yaml", "file"))
        .unionByName(mark("k % 5 = 1", home, "npm-shrinkwrap.json", "file"))
        .unionByName(mark("k % 20 < 4", mid, "package-lock.json", "file"))
        .distinct()
    )
    return starts, inventory


def project_roots(spark, sf_dir):
    return markers.project_roots(*_markers(spark, sf_dir), home="/w")


QUERIES = [
    manifest_diff, manifest_summary, manifest_status, manifest_remap, manifest_dirty, stat_verdicts, content_dedup, digest_of_digests_md5,
    digest_of_digests, digest_concat, digest_concat_md5, digest_strings, digest_page_ranges, hex_digests, values_equal, lz4_bounds,
    lz4_round_trip, paths_safe, paths_relative, paths_normalized, paths_common_root, paths_encoded, ancestor_dirs, project_roots,
]

ORACLES = {
    "manifest_diff": f"WITH {_SNAPSHOTS} SELECT doc_id, change FROM d",
    "manifest_summary": f"WITH {_SNAPSHOTS} SELECT change, count(*) AS n FROM d GROUP BY change",
    "manifest_status": f"WITH {_SNAPSHOTS} SELECT CASE WHEN bool_or(change <> 'same') THEN 'changed' ELSE 'upToDate' END AS status FROM d",
    "manifest_remap": f"WITH {_SNAPSHOTS} SELECT b.doc_id::VARCHAR AS path, a.digest IS NOT NULL AS inherited, a.digest AS old_digest FROM b LEFT JOIN a USING (doc_id)",
    "manifest_dirty": f"WITH {_SNAPSHOTS} SELECT doc_id, change FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "stat_verdicts": """SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 AND o_orderkey % 10 = 0 THEN 'changed' WHEN o_orderkey % 6 = 0 THEN 'changed'
        WHEN o_orderkey % 3 = 0 THEN 'read' ELSE 'ok' END AS verdict FROM orders""",
    "content_dedup": "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "digest_of_digests_md5": "SELECT conv_id, count(*) AS n, md5(unhex(string_agg(md5(text), '' ORDER BY turn))) AS hex FROM conversations GROUP BY conv_id",
    "digest_concat_md5": "SELECT conv_id, count(*) AS n, md5(string_agg(text, '' ORDER BY turn)) AS hex FROM conversations GROUP BY conv_id",
    "hex_digests": "SELECT doc_id, md5(text) AS hex, '' AS short, md5(text) || ',' || md5(text) AS pair, 0::INT AS n_bad FROM documents",
    "values_equal": "SELECT a.doc_id, coalesce(a.text = b.text, false) AS equal FROM documents a LEFT JOIN documents b ON a.doc_id = b.doc_id + 1",
    "lz4_bounds": "SELECT doc_id, (strlen(text) + strlen(text) // 255 + 16)::BIGINT AS bound FROM documents",
    "lz4_round_trip": "SELECT doc_id, true AS same, true AS fits FROM documents",
    "paths_safe": f"WITH {_PAGE_PATHS} SELECT page_id, false AS absolute_safe, NOT regexp_matches(substr(path, 2), '^$|^[/\\\\]|^.:|(^|/)\\.\\.(/|$)') AS relative_safe FROM p",
    "paths_relative": f"WITH {_PAGE_PATHS} SELECT page_id, array_to_string(list_filter(string_split(path, '/'), lambda s: s <> ''), '/') AS rel, NULL::VARCHAR AS outside FROM p",
    "paths_normalized": f"WITH {_PAGE_PATHS} SELECT DISTINCT array_to_string(list_filter(string_split(regexp_replace(path, '[0-9]+', 'n', 'g'), '/'), lambda s: s <> ''), '/') AS path FROM p",
    "paths_common_root": f"""WITH {_PAGE_PATHS}, q AS (SELECT page_id % 13 AS g, string_split('/srv/' || ((page_id % 13) % 2) || path, '/')[:-2] AS s FROM p),
        r AS (SELECT g, min(s) AS a, max(s) AS b FROM q GROUP BY g)
        SELECT g AS "group", array_to_string(a[1:coalesce(list_min(list_filter(range(1, len(a) + 1), lambda i: a[i] IS DISTINCT FROM b[i])), len(a) + 1) - 1], '/') AS root FROM r""",
    "paths_encoded": f"WITH {_PAGE_PATHS} SELECT page_id % 17 AS g, md5(string_agg(path || chr(0), '' ORDER BY page_id)) AS digest, count(*) AS n FROM p GROUP BY 1",
    "ancestor_dirs": f"""WITH {_PAGE_PATHS}, s AS (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM p)
        SELECT page_id, d::INT AS depth, '/' || array_to_string(s[1:len(s) - d], '/') AS dir FROM (SELECT page_id, s, unnest(range(0, len(s) + 1)) AS d FROM s)""",
    "project_roots": """WITH s AS (SELECT DISTINCT s_suppkey AS k, '/w/g' || (s_suppkey % 5) AS h, '/w/g' || (s_suppkey % 5) || '/p' || (s_suppkey % 20) AS m,
          s_suppkey % 20 IN (3, 6, 11) AS git_m, s_suppkey % 5 < 3 AS git_h FROM supplier),
        q AS (SELECT *, CASE WHEN git_m THEN m WHEN git_h THEN h END AS git_root, CASE WHEN git_h THEN h WHEN k % 20 IN (6, 11) THEN m END AS top,
          CASE WHEN k % 20 < 9 THEN m END AS pm, CASE WHEN k % 5 < 4 AND NOT git_m THEN h END AS ph,
          CASE WHEN k % 20 BETWEEN 5 AND 12 THEN m END AS tm, CASE WHEN k % 5 = 0 AND NOT git_m THEN h END AS th,
          CASE WHEN k % 20 IN (1, 6) THEN m END AS nm, CASE WHEN k % 5 = 1 AND NOT git_m THEN h END AS nh FROM s)
        SELECT m || '/s' || k AS start, git_root, CASE WHEN top <> git_root THEN top END AS git_super_root,
        coalesce(pm, ph) || '/package.json' AS nearest_package_json, coalesce(ph, pm) || '/package.json' AS root_package_json,
        coalesce(tm, th) || '/tsconfig.json' AS nearest_tsconfig, coalesce(th, tm) || '/tsconfig.json' AS root_tsconfig,
        coalesce(nm, nh) || '/node_modules' AS nearest_node_modules, coalesce(nh, nm) || '/node_modules' AS root_node_modules,
        CASE WHEN ph IS NOT NULL THEN CASE k % 5 WHEN 2 THEN h || '/pnpm-lock.yaml' WHEN 1 THEN h || '/yarn.lock' END
          WHEN pm IS NOT NULL AND k % 20 < 4 THEN m || '/package-lock.json' END AS root_lockfile FROM q""",
}


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
