"""Incremental gap fill: external pins arrive as a stream, the directory is a table.

An extension: nothing in the workload needs it.  Each micro-batch is matched against the
directory as it then stands; pins without a match are appended to it, so a later pin finds
what an earlier batch added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pinfold.operators.cells import without_near


def stream_gap_fill(
    external: DataFrame, directory: Callable[[], DataFrame], append: Callable[[DataFrame, int], None], checkpoint: str, radius_m: float = 250.0, on: tuple[str, ...] = ("rel",)
) -> StreamingQuery:
    """Start the query; ``append(gaps, batch_id)`` must write a batch once (by its id)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        append(without_near(batch, directory(), radius_m, list(on)), batch_id)

    return external.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
