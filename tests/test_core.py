import os

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymark import queries
from tallymark.functions import compression, hashing, paths
from tallymark.operators import compare, digests, markers
from tallymark.plans.manifest import Manifest, diff
from tallymark.sources import files
from tallymark.streaming.watch import watch

# Published digests of small files, alone and in order.
GOLDEN = {b"hello world\n": "eefac9d87100cd1336b2e733a5484425", b"goodbye world\n": "472e10c9821c728278f31afb08378f2f", b"nested file\n": "83aa87b8500caa36868059af27b50144", b"": "99aa06d3014798d86001c324468d497f"}
A_B, B_A, A_B_C, A_MISSING = "14cb7b529dbb3358999291d5315f9ec8", "b96712ebc4252558f427015fab836b59", "310258854c72a729c6d3151d057d20bb", "3bd4a3acde4c43af41d10b55b7dcc098"
SIZES = {0: "99aa06d3014798d86001c324468d497f", 256: "f1f8a93f50849ac39408a4433b952d71", 131073: "e4068c0fc25b3c45e39ce30528538126", 1048576: "1b208d2839093774d36c0e13a3df139e"}


def test_golden_digests(spark):
    rows = spark.createDataFrame([(bytearray(k),) for k in GOLDEN], "data binary").select("data", hashing.to_hex(hashing.digest(F.col("data"))).alias("hex")).collect()
    assert {bytes(r.data): r.hex for r in rows} == GOLDEN
    sized = spark.createDataFrame([(n, bytearray(i & 0xFF for i in range(n))) for n in SIZES], "n int, data binary")
    assert {r.n: r.hex for r in sized.select("n", hashing.to_hex(hashing.digest(F.col("data"))).alias("hex")).collect()} == SIZES
    assert spark.range(1).select(hashing.to_hex(hashing.digest_string(F.lit("hello world"))).alias("h")).first().h == "df8d09e93f874900a99b8775cc15b6c7"


def test_ranges_hex_and_bytes(spark):
    df = spark.createDataFrame([(bytearray(range(40)),)], "d binary")
    want = xxhash.xxh3_128_hexdigest(bytes(range(5, 15)))
    assert df.select(hashing.to_hex(hashing.digest_range(F.col("d"), 5, 10)).alias("h")).first().h == want
    with pytest.raises(Exception):
        df.select(hashing.digest_range(F.col("d"), 30, 20)).collect()
    r = df.select(hashing.to_hex(F.col("d"), 30).alias("short"), hashing.to_hex_array(F.substring("d", 1, 32)).alias("two"), hashing.to_hex_array(F.col("d")).alias("none"), hashing.reverse_bytes(F.col("d")).alias("r")).first()
    assert r.short == "" and r.two == [bytes(range(16)).hex(), bytes(range(16, 32)).hex()] and r.none == [] and bytes(r.r) == bytes(range(40))[::-1]


def test_digests_of_groups(spark):
    rows = [("ab", 0, b"hello world\n"), ("ab", 1, b"goodbye world\n"), ("ba", 0, b"goodbye world\n"), ("ba", 1, b"hello world\n"), ("abc", 0, b"hello world\n"), ("abc", 1, b"goodbye world\n"), ("abc", 2, b"nested file\n"), ("am", 0, b"hello world\n"), ("am", 1, None)]
    df = spark.createDataFrame([(g, o, None if c is None else bytearray(c)) for g, o, c in rows], "g string, o int, c binary")
    got = {r.g: r.hex for r in digests.digest_of_digests(df, ["g"], "o", F.col("c"), "zero").collect()}
    assert got == {"ab": A_B, "ba": B_A, "abc": A_B_C, "am": A_MISSING}
    with pytest.raises(Exception):
        digests.digest_of_digests(df, ["g"], "o", F.col("c")).collect()
    concat = {r.g: r.hex for r in digests.digest_concat(df, ["g"], "o", F.col("c")).collect()}
    assert concat["ab"] == xxhash.xxh3_128_hexdigest(b"hello world\ngoodbye world\n") != got["ab"]
    assert concat["am"] == GOLDEN[b"hello world\n"]


def test_stream(tmp_path):
    p = tmp_path / "a"
    p.write_bytes(b"hello world\n")
    s = digests.HashStream().add("hello ").add(b"xxworld\n", 2)
    other = s.clone()
    assert s.hexdigest() == s.hexdigest() == GOLDEN[b"hello world\n"] == digests.HashStream().add_file(str(p)).hexdigest()
    other.add("more")
    assert other.hexdigest() != s.hexdigest() and s.reset().hexdigest() == GOLDEN[b""]
    assert digests.HashStream(1).add("a").digest() == xxhash.xxh3_128_digest(b"a", 1)
    assert digests.HashStream().add_file_digests([str(p), str(tmp_path / "none")], False).hexdigest() == A_MISSING
    with pytest.raises(OSError):
        s.add_files([str(tmp_path / "none")])


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_lz4_round_trip(data):
    block = compression.compress(data)
    assert compression.decompress(block, len(data)) == data
    if data:
        with pytest.raises(ValueError):
            compression.decompress(block, len(data) + 1)


def test_lz4_columns(spark, tmp_path):
    df = spark.createDataFrame([(bytearray(b"ab" * 500), 1000), (bytearray(b""), 0), (None, 0)], "d binary, n int")
    rows = df.select("d", compression.lz4_unblock(compression.lz4_block(F.col("d")), F.col("n")).alias("back"), compression.lz4_bound(F.col("n")).alias("bound")).collect()
    assert all(r.d == r.back for r in rows) and rows[0].bound == 1000 + 3 + 16
    with pytest.raises(ValueError):
        compression.decompress(b"x", (256 << 20) + 1)
    for n in ("a.txt", "empty"):
        (tmp_path / n).write_bytes(b"text " * 1000 if n == "a.txt" else b"")
    packed = files.read_compressed(spark, *[str(tmp_path / n) for n in ("a.txt", "empty")])
    out = packed.withColumn("path", F.concat(F.lit(str(tmp_path / "out") + "/"), F.element_at(F.split("path", "/"), -1)))
    assert files.write_decompressed(out) == 2
    assert (tmp_path / "out/a.txt").read_bytes() == b"text " * 1000 and (tmp_path / "out/empty").read_bytes() == b""


def test_paths():
    assert paths.common_root(["/srv/data/x/1.bin", "/srv/data/xy/2.bin"]) == "/srv/data"  # whole segments only
    assert paths.common_root(["/one.bin", "/srv/two.bin"]) == "/" and paths.common_root([]) == "" == paths.common_root(["lone.bin"])
    assert paths.common_root(["x/1", "../y/2"], base="/srv/in") == "/srv" and paths.common_root(["/srv/x/1", "/opt/y"], allowed="/srv") == "/srv/x"
    assert paths.relative("/r", "/r/../x") is None and paths.relative("/r", "/r/./x") == "x" and paths.relative("/r", "/r") is None
    assert paths.normalized("/r", ["b", "/r/a", "./b", "/q", ""]) == ["a", "b"]
    for listed in ([], ["a"], ["ü", "", "😀 x"]):
        assert paths.decode(paths.encode(listed)) == listed
    assert paths.encode(["a\0b"]) == b"\0" and paths.decode(b"a\0tail") == ["a"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("xyz"), min_size=1, max_size=4), min_size=1, max_size=5))
def test_common_root_by_segments(listed):
    """The root holds every file, and no folder below it on the way to the first file does."""
    root = paths.common_root(["/" + "/".join(f) for f in listed]).strip("/")
    depth = len(root.split("/")) if root else 0
    assert all("/".join(f[:depth]) == root and len(f) > depth for f in listed)
    assert len(listed[0]) == depth + 1 or any(f[: depth + 1] != listed[0][: depth + 1] or len(f) == depth + 1 for f in listed)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab./", max_size=8), max_size=6))
def test_normalizing_again_changes_nothing(listed):
    once = paths.normalized("/r", listed)
    assert paths.normalized("/r", once) == once


def test_files_and_equality(spark, tmp_path):
    for n, c in (("a", b"hello world\n"), ("b", b"hello world\n"), ("c", b"hello_world\n"), ("d", b"short")):
        (tmp_path / n).write_bytes(c)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/e").write_bytes(b"nested file\n")
    at = lambda n: str(tmp_path / n)
    pairs = spark.createDataFrame([(at("a"), at(n)) for n in ("a", "b", "c", "d", "none")] + [(None, at("a"))], "a string, b string")
    assert [r.equal for r in compare.files_equal(pairs.coalesce(1)).collect()] == [True, True, False, False, False, False]
    spark.dataSource.register(files.FileStatSource)
    rows = spark.read.format("file_stat").option("hash", "true").load(str(tmp_path)).collect()
    assert {os.path.basename(r.path): bytes(r.content_hash).hex() for r in rows}["e"] == GOLDEN[b"nested file\n"] and len(rows) == 5
    s = os.stat(at("a"))
    assert {(r.size, r.mtime_ns, r.ctime_ns) for r in rows if r.path == at("a")} == {(12, s.st_mtime_ns, s.st_ctime_ns)}
    listed = spark.createDataFrame([(0, at("a")), (1, at("none"))], "o int, path string")
    assert [r.hex for r in files.digest_files(listed, "zero", ordinal_col="o").orderBy("ordinal").collect()] == [GOLDEN[b"hello world\n"], "0" * 32]
    assert files.digest_files(listed, "skip").count() == 1
    with pytest.raises(Exception):
        files.digest_files(listed).collect()


def test_markers(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "packages/a/src").mkdir(parents=True)
    (repo / ".git").mkdir()
    for f in ("package.json", "tsconfig.json", "packages/a/package.json", "packages/a/tsconfig.json", "yarn.lock"):
        (repo / f).write_text("{}")
    got = markers.walk(str(repo / "packages/a/src"), home="/nowhere")
    assert got["gitRoot"] == str(repo) and got["gitSuperRoot"] is None and got["rootLockfile"] == str(repo / "yarn.lock")
    assert got["nearestPackageJson"] == str(repo / "packages/a/package.json") and got["rootPackageJson"] == str(repo / "package.json")
    assert markers.walk(str(repo / "packages/a/src"), home=str(repo))["gitRoot"] is None
    assert markers.walk_nearest(str(repo / "packages/none/x"), home="/nowhere")["nearestTsconfig"] == str(repo / "tsconfig.json")
    with pytest.raises(ValueError):
        markers.walk("")
    found = [(str(p), "dir" if p.is_dir() else "file", 0) for p in repo.rglob("*")]
    table = markers.project_roots(spark.createDataFrame([(str(repo / "packages/a/src"),)], "start string"), spark.createDataFrame(found, "path string, kind string, mtime_ns long")).first()
    assert (table.git_root, table.git_super_root, table.root_lockfile) == (got["gitRoot"], None, got["rootLockfile"])
    assert (table.nearest_package_json, table.root_tsconfig) == (got["nearestPackageJson"], got["rootTsconfig"])


def test_marker_bounds(spark, tmp_path):
    """Nearest markers stay inside the innermost repository, and lock files need a package.json beside them."""
    outer = tmp_path / "outer"
    inner = outer / "inner"
    (inner / "src").mkdir(parents=True)
    (outer / ".git").mkdir()
    (inner / ".git").write_text("gitdir: elsewhere")
    for f in ("outer/package.json", "outer/tsconfig.json", "outer/inner/yarn.lock"):
        (tmp_path / f).write_text("{}")
    (outer / "node_modules/pkg").mkdir(parents=True)
    starts = {"inner": inner / "src", "outer": outer / "node_modules/pkg"}
    want = {
        "inner": {"gitRoot": str(inner), "gitSuperRoot": str(outer), **{f"{k}{f}": None for k in ("nearest", "root") for f in ("PackageJson", "Tsconfig", "NodeModules")}, "rootLockfile": None},
        "outer": {"gitRoot": str(outer), "gitSuperRoot": None, "nearestPackageJson": str(outer / "package.json"), "nearestTsconfig": str(outer / "tsconfig.json"), "nearestNodeModules": str(outer / "node_modules"), "rootPackageJson": str(outer / "package.json"), "rootTsconfig": str(outer / "tsconfig.json"), "rootNodeModules": str(outer / "node_modules"), "rootLockfile": None},
    }
    got = {k: markers.walk(str(p), home="/nowhere") for k, p in starts.items()}
    assert got == want and set(markers.walk_nearest(str(starts["inner"]), home="/nowhere").values()) == {None}
    (outer / "npm-shrinkwrap.json").write_text("{}")
    assert markers.walk(str(outer), home="/nowhere")["rootLockfile"] is None
    found = spark.createDataFrame([(str(p), "dir" if p.is_dir() else "file", 0) for p in outer.rglob("*")], "path string, kind string, mtime_ns long")
    table = {r.start: r for r in markers.project_roots(spark.createDataFrame([(str(p),) for p in starts.values()], "start string"), found).collect()}
    snake = {"gitRoot": "git_root", "gitSuperRoot": "git_super_root", "rootLockfile": "root_lockfile", **{f"{k}{f}": f"{k}_{g}" for k in ("nearest", "root") for f, g in (("PackageJson", "package_json"), ("Tsconfig", "tsconfig"), ("NodeModules", "node_modules"))}}
    for k, p in starts.items():
        assert {f: table[str(p)][c] for f, c in snake.items()} == want[k]
    bounded = markers.project_roots(spark.createDataFrame([(str(inner / "src"),)], "start string"), found, stop=str(inner)).first()
    assert set(bounded.asDict().values()) == {None, str(inner / "src")}


def test_manifest_flows(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    listed = [str(root / n) for n in ("a.txt", "b.txt", "c.txt")]
    for f in listed:
        open(f, "w").write(os.path.basename(f) + "\n")
    make = lambda **k: Manifest(spark, str(tmp_path / "m"), **({"files": listed, "root": str(root), "version": 1} | k))

    def status(m):
        with m.open() as s:
            return s.status

    with make().open() as s:
        assert s.status == "missing" and s.config_changed
        assert s.write(values=(1.0, 2.0, 3.0, 4.0), uncompressed=[b"blob"]) == "written"
        with pytest.raises(RuntimeError):
            s.write()
    m = make()
    assert m.needs_open and status(m) == "upToDate" and not m.needs_open and not m.changed_on_disk() and m.payloads("uncompressed") == [b"blob"]
    assert status(make(version=2)) == "staleVersion" and status(make(fingerprint=b"x" * 16)) == "stale"
    with pytest.raises(TypeError):
        make(fingerprint=b"x")
    assert status(make(files=listed[:2])) == "changed" and status(make(files=[])) == "upToDate"
    with make(files=None).open() as s:
        assert s.files() == ["a.txt", "b.txt", "c.txt"] and not s.config_changed
    os.utime(listed[0], ns=(1, 1))
    assert status(make()) == "statsDirty"
    open(listed[1], "w").write("B.txt\n")
    with make().open() as s:
        assert s.status == "changed" and {r.path: r.changed for r in s.resolve().collect()} == {"a.txt": False, "b.txt": True, "c.txt": False}
        open(listed[2], "w").write("later than the look\n")  # a session looks once
        assert not s.find("c.txt").changed and s.find(listed[1]).changed and s.find("none") is None
        open(listed[2], "w").write("c.txt\n")
        assert s.write() == "written"
    with make().open() as s:
        assert s.values == [1.0, 2.0, 3.0, 4.0]
    os.remove(listed[2])
    with make().open() as s:
        row = s.find("c.txt")
        assert s.status == "changed" and row.missing and row.content_hash_hex == "0" * 32
    m = make()
    assert m.overwrite() == "written" and make().payloads("uncompressed") == []
    open(listed[0], "w").write("edited without a hint\n")
    assert status(m) == "upToDate"
    m.invalidate(listed[0])
    assert status(m) == "changed"
    with m.locked():
        assert make().is_locked() and status(make(lock_timeout_ms=0)) == "lockFailed" and not make().wait_unlocked(10)
    assert make().wait_unlocked(10)
    (tmp_path / "m/current.json").write_text("junk")
    assert status(make()) == "missing"
    assert not [p for p in os.listdir(tmp_path / "m") if p.startswith(".scan")]


def test_one_session_at_a_time(spark, tmp_path):
    (tmp_path / "a").write_text("one")
    make = lambda: Manifest(spark, str(tmp_path / "m"), files=[str(tmp_path / "a")], root=str(tmp_path), lock_timeout_ms=0)
    first = make().open()
    second = make().open()
    assert make().is_locked() and (first.status, second.status) == ("missing", "lockFailed") and second.write() == "lockFailed"
    assert first.write() == "written" and not make().is_locked()
    old = make().open()
    rows = old.resolve()
    old.write()
    with make().open() as third:
        assert third.status == "upToDate" and rows.sparkSession is spark and make().open().status == "lockFailed"
    assert not make().is_locked()


def test_watch(spark, tmp_path):
    root, events = tmp_path / "tree", tmp_path / "events"
    root.mkdir()
    events.mkdir()
    (root / "a").write_text("one")
    m = Manifest(spark, str(tmp_path / "m"), files=[str(root / "a")], root=str(root))
    m.overwrite()
    (root / "a").write_text("two!")
    (events / "1.json").write_text('{"path": "a"}\n')
    seen = []
    watch(spark.readStream.schema("path string").json(str(events)), m, lambda status, changed: seen.append((status, changed)), str(tmp_path / "cp")).awaitTermination()
    with m.open() as session:
        assert seen == [("changed", ["a"])] and session.status == "upToDate"


def test_diff_mirrors(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, d string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, d string")
    change = lambda p, q: {r.k: r.change for r in diff(p, q, "k", "d").collect()}
    assert change(a, b) == {1: "removed", 2: "changed", 3: "same", 4: "added"}
    assert set(change(a, a).values()) == {"same"} and change(b, a)[1] == "added"


def test_page_ranges_cover_whole_pages(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html.encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.digest_page_ranges(spark, sf).collect()
    hexed = lambda b: xxhash.xxh3_128_digest(b).hex()
    assert {r.page_id: (r.hex, r.rest) for r in rows} == {i: (hexed(h[:16]), hexed(h[16:])) for i, h in pages.items()}
