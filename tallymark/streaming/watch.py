"""Watch mode: a stream of path events drives checks of only those paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.manifest import Manifest


def watch(events: DataFrame, manifest: Manifest, on_status: Callable[[str, list[str]], None], checkpoint: str, path_col: str = "path") -> StreamingQuery:
    """For each micro-batch of path events: invalidate those paths, open, report the status and write if needed.

    A batch's distinct paths are what changed since the last one; they are bounded by the manifest's own list.
    """

    def each(batch: DataFrame, _: int) -> None:
        changed = [r[0] for r in batch.select(path_col).distinct().collect() if r[0]]
        manifest.invalidate(*changed)
        with manifest.open() as session:
            on_status(session.status, changed)
            if session.needs_write:
                session.write()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
