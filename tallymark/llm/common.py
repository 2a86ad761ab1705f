"""What the corpus operators share: scratch tables, Arrow passes and input tidying."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset (tests, a laptop) a local temporary folder is used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    fallback = spark.sparkContext.getCheckpointDir()
    if fallback is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallymark-"))
        fallback = spark.sparkContext.getCheckpointDir()
    return fallback.rstrip("/")


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, and it is computed once."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tallymark/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator reads, under fixed names, so that other columns cannot clash."""
    return df.select(
        df[id_col].cast("long").alias("doc_id"),
        df[text_col].cast("string").alias("text"),
        *[df[c].alias(c) for c in more],
    )


def free_name(taken: list[str], name: str) -> str:
    """A column name like ``name`` that is none of those taken, whatever their case."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """What tells rows apart whose ids don't: a digest of the text; a null text counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def each_row(
    df: DataFrame, schema: str, make: Callable[[], Callable[..., tuple | None]], columns: list[str], rows_out: int = 2000
) -> DataFrame:
    """Run a Python function over rows in Arrow batches.

    ``make`` is called once per task and returns a function of the row's values giving one output tuple, or None for
    no row.  Output is flushed every ``rows_out`` rows, so memory follows a batch and not a partition.
    """
    return many_rows(df, schema, lambda: _one(make()), columns, rows_out)


def _one(f):
    def run(*values):
        out = f(*values)
        return () if out is None else (out,)

    return run


def many_rows(
    df: DataFrame, schema: str, make: Callable[[], Callable[..., object]], columns: list[str], rows_out: int = 2000
) -> DataFrame:
    """As ``each_row`` for functions that give any number of tuples for a row."""
    arrow_schema = to_arrow(df.sparkSession, schema)
    df = df.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        out: list[tuple] = []
        for batch in batches:
            lists = [batch.column(c).to_pylist() if not _is_text(batch.column(c)) else batch.column(c) for c in range(batch.num_columns)]
            for i in range(batch.num_rows):
                out.extend(f(*[x[i].as_py() if isinstance(x, pa.Array) else x[i] for x in lists]))
                if len(out) >= rows_out:
                    yield as_batch(out, arrow_schema)
                    out = []
        if out:
            yield as_batch(out, arrow_schema)

    return df.mapInArrow(run, schema)


def _is_text(column: pa.Array) -> bool:
    return pa.types.is_string(column.type) or pa.types.is_large_string(column.type)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def ascii_lower(column):
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
