"""LZ4 blocks as column expressions. A block doesn't carry its uncompressed size, so callers keep it."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

MAX_INPUT = 0x7E000000  # the block format's limit
MAX_OUTPUT = 256 << 20


def compress(data: bytes) -> bytes:
    if len(data) > MAX_INPUT:
        raise ValueError("input is too large for one block")
    return pa.compress(data, codec="lz4_raw", asbytes=True) if data else b""


def _fits(data: bytes, size: int) -> bytes | None:
    """The block's content in a buffer of ``size`` bytes, None if it is no block or has more."""
    try:
        return pa.decompress(data, decompressed_size=size, codec="lz4_raw", asbytes=True)
    except (OSError, pa.ArrowException):
        return None


def decompress(data: bytes, size: int) -> bytes:
    """Exactly ``size`` bytes, else an error.

    A block doesn't say how much it holds: it holds ``size`` bytes if they fit that room and not one byte less.
    """
    if not 0 <= size <= MAX_OUTPUT:
        raise ValueError(f"size must lie in 0..{MAX_OUTPUT}")
    if size == 0:
        if data:
            raise ValueError("the block holds more than the size given")
        return b""
    content = _fits(data, size)
    if content is None or _fits(data, size - 1) is not None:
        raise ValueError("not an LZ4 block of that size")
    return content


@F.pandas_udf(BinaryType())
def lz4_block(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else compress(bytes(x)))


@F.pandas_udf(BinaryType())
def lz4_unblock(data: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or pd.isna(n) else decompress(bytes(d), int(n)) for d, n in zip(data, size)], dtype=object)


def lz4_bound(size: Column) -> Column:
    """The greatest size of a block for so many bytes; 0 beyond the format's limit."""
    size = size.cast("long")
    return F.when((size >= 0) & (size <= MAX_INPUT), size + F.floor(size / 255) + 16).otherwise(F.lit(0)).cast("long")


def range_of(data: Column, offset: int, length: int | None = None) -> Column:
    return F.substring(data, F.lit(offset + 1), F.octet_length(data) - offset if length is None else F.lit(length))
