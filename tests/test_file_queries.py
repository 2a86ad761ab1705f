import duckdb
import pytest

from tallymark import file_queries
from tallymark.functions import compression, paths
from tallymark.sources import files

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(file_queries.queries()))
def test_as_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    rows = file_queries.queries()[name](spark, SMALL)
    twin = db.sql(file_queries.oracle_sql()[name])
    assert sorted(rows.columns) == sorted(twin.columns)
    assert sorted(map(tuple, rows.select(*twin.columns).collect())) == sorted(twin.fetchall())


def test_one_look_at_a_file(tmp_path):
    """Stat and digest come from one opening; a folder is no file, and a missing one gives nothing."""
    (tmp_path / "a").write_bytes(b"hello world\n")
    at = str(tmp_path / "a")
    assert files.stat_and_hash(at) == (*files.stat_row(at), files.hash_file(at))
    assert files.stat_and_hash(str(tmp_path)) is None is files.stat_and_hash(at + "0")


@pytest.mark.parametrize("n", [1, 2, 15, 300, 70_000])
def test_blocks_of_another_size(n):
    for data in (b"x" * n, bytes(i * i * 7 % 251 for i in range(n))):
        block = compression.compress(data)
        assert compression.decompress(block, n) == data
        for size in {0, n - 1, n + 1, 2 * n}:
            with pytest.raises(ValueError):
                compression.decompress(block, size)


def test_absolute_paths():
    assert paths.absolute("/r", ["a/b", "/q"]) == ["/r/a/b", "/q"] and paths.absolute("/", ["a"]) == ["/a"]
