"""Digests of groups of rows.

``digest_of_digests`` hashes rows in parallel and then the row digests in order: the form that scales.
``digest_concat`` hashes the rows' bytes one after another, which no partial result can stand for.  Both read a group's
rows, or 16 bytes for each, through one task, which keeps only the hash's state.
"""

from __future__ import annotations

from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing

def digest_of_digests(
    df: DataFrame, group: list[str], order: str, content: Column, on_error: str = "fail", seed: int = 0,
    row_digest: Callable[[Column], Column] | None = None, state: Callable[[], object] | None = None,
) -> DataFrame:
    """(group..., n, digest, hex) with digest = H(H(row 1) || H(row 2) ...) in the order given.

    Null content: ``fail`` raises, ``zero`` stands for 16 zero bytes, ``skip`` leaves the row out.  ``row_digest`` and
    ``state`` put another hash in the place of XXH3.
    """
    each = row_digest(content) if row_digest else hashing.digest(content, seed)
    if on_error == "zero":
        each = F.coalesce(each, hashing.zero_digest())
    elif on_error == "fail":
        each = F.coalesce(each, F.raise_error(F.lit("unreadable content")).cast("binary"))
    elif on_error != "skip":
        raise ValueError("on_error is fail, zero or skip")
    rows = df.select(*group, F.col(order).alias("_order"), each.alias("_digest"))
    return digest_concat(rows, group, "_order", F.col("_digest"), seed, state)


def digest_concat(
    df: DataFrame, group: list[str], order: str, content: Column, seed: int = 0, state: Callable[[], object] | None = None
) -> DataFrame:
    """(group..., n, digest, hex) with digest = H(row 1 || row 2 ...) in the order given; null content is skipped.

    Rows come sorted and in pieces to the task of their group, which keeps only the hash's state.
    """
    import pyarrow as pa

    rows = df.select(*group, F.col(order).alias("_order"), content.alias("_data"))
    fields = {f.name: f for f in df.select(*group).schema.fields}
    ordered = rows.repartition(*group).sortWithinPartitions(*group, "_order") if group else rows.repartition(1).sortWithinPartitions("_order")
    width = len(group)

    def run(batches):
        fresh = state or (lambda: xxhash.xxh3_128(seed=seed))
        key, hashed, n = None, None, 0
        out = []

        def batch():
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        types = names = None
        for b in batches:
            if types is None:
                types = [b.schema.field(i).type for i in range(width)] + [pa.int64(), pa.binary()]
                names = [*group, "n", "digest"]
            keys = [b.column(i).to_pylist() for i in range(width)]
            for r in range(b.num_rows):
                now = tuple(k[r] for k in keys)
                if hashed is None or now != key:
                    if hashed is not None:
                        out.append((*key, n, hashed.digest()))
                    key, hashed, n = now, fresh(), 0
                    if len(out) > 2000:
                        yield batch()
                        out.clear()
                data = b.column(width + 1)[r].as_py()
                if data is not None:
                    hashed.update(data)
                    n += 1
        if hashed is not None:
            out.append((*key, n, hashed.digest()))
        if out:
            yield batch()

    schema = ", ".join([*(f"`{g}` {fields[g].dataType.simpleString()}" for g in group), "n long", "digest binary"])
    return ordered.mapInArrow(run, schema).withColumn("hex", hashing.to_hex(F.col("digest")))


class HashStream:
    """A digest over pieces added in order, on the driver. ``digest`` may be asked for at any time."""

    def __init__(self, seed_low: int = 0, seed_high: int = 0):
        self._seed = hashing.join_seed(seed_low, seed_high)
        self._state = xxhash.xxh3_128(seed=self._seed)

    def add(self, data: bytes | str, offset: int = 0, length: int | None = None) -> "HashStream":
        data = data.encode() if isinstance(data, str) else data
        end = len(data) if length is None else offset + length
        if not 0 <= offset <= end <= len(data):
            raise IndexError("range is outside the value")
        self._state.update(memoryview(data)[offset:end])
        return self

    def add_file(self, path: str, must_exist: bool = True) -> "HashStream":
        try:
            with open(path, "rb") as f:
                while data := f.read(1 << 20):
                    self._state.update(data)
        except OSError:
            if must_exist:
                raise
        return self

    def add_files(self, paths: list[str], must_exist: bool = True) -> "HashStream":
        for p in paths:
            self.add_file(p, must_exist)
        return self

    def add_file_digests(self, paths: list[str], must_exist: bool = True) -> "HashStream":
        """Each file's own digest instead of its content; zeros for one that can't be read."""
        from ..sources.files import hash_file

        for p in paths:
            found = hash_file(p)
            if found is None and must_exist:
                raise FileNotFoundError(p)
            self._state.update(found or hashing.ZERO)
        return self

    def digest(self) -> bytes:
        return self._state.digest()

    def hexdigest(self) -> str:
        return self._state.hexdigest()

    def reset(self, seed_low: int | None = None, seed_high: int | None = None) -> "HashStream":
        if seed_low is not None or seed_high is not None:
            self._seed = hashing.join_seed(seed_low or 0, seed_high or 0)
        self._state = xxhash.xxh3_128(seed=self._seed)
        return self

    def clone(self) -> "HashStream":
        other = HashStream()
        other._seed, other._state = self._seed, self._state.copy()
        return other
