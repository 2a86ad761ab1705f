"""XXH3-128 digests as column expressions, and their hexadecimal forms.

Digests are 16 bytes in canonical (big-endian) order.  Spark's own ``hash`` and ``xxhash64`` are other functions and
stand in for none of these.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

ZERO = bytes(16)  # stands for content that can't be read


def join_seed(low: int = 0, high: int = 0) -> int:
    return (high & 0xFFFFFFFF) << 32 | (low & 0xFFFFFFFF)


@lru_cache(maxsize=64)
def _digest_udf(seed: int):
    @F.pandas_udf(BinaryType())
    def xxh3_128(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else xxhash.xxh3_128_digest(bytes(x), seed))

    return xxh3_128


def digest(data: Column, seed: int = 0) -> Column:
    """XXH3-128 of binary values; null for null."""
    return _digest_udf(seed)(data)


def digest_string(text: Column, seed: int = 0) -> Column:
    """XXH3-128 of a string's UTF-8 bytes."""
    return digest(F.encode(text, "UTF-8"), seed)


def digest_range(data: Column, offset: int, length: int | None = None, seed: int = 0) -> Column:
    """XXH3-128 of part of a value; a part that doesn't lie inside it is an error, unlike with ``substring``."""
    if offset < 0 or (length is not None and length < 0):
        raise ValueError("offset and length can't be negative")
    size = F.octet_length(data)
    rest = size - offset if length is None else F.lit(length)
    inside = (F.lit(offset) <= size) & (F.lit(offset) + rest <= size)
    part = F.substring(data, F.lit(offset + 1), rest.cast("int"))
    return digest(F.when(data.isNull() | inside, part).otherwise(F.raise_error(F.lit("range is outside the value")).cast("binary")), seed)


def zero_digest() -> Column:
    return F.unhex(F.lit("00" * 16))


def to_hex(value: Column, offset: int = 0) -> Column:
    """32 lower-case hexadecimal digits of the 16 bytes at ``offset``; an empty string if they aren't there."""
    part = F.lower(F.hex(F.substring(value, offset + 1, 16)))
    return F.when(F.octet_length(value) >= offset + 16, part).otherwise(F.lit(""))


def to_hex_array(value: Column) -> Column:
    """Hexadecimal digests of a run of 16-byte digests; an empty array if the length isn't a multiple of 16."""
    size = F.octet_length(value)
    many = F.transform(F.sequence(F.lit(0), (size / 16).cast("int") - 1), lambda i: F.lower(F.hex(F.substring(value, i * 16 + 1, F.lit(16)))))
    return F.when((size > 0) & (size % 16 == 0), many).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(BinaryType())
def reverse_bytes(value: pd.Series) -> pd.Series:
    """The other byte order of a digest."""
    return value.map(lambda x: None if x is None else bytes(x)[::-1])
