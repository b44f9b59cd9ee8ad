"""Corpus metrics over a stream of document pairs.

Counters only add up, so running totals need no watermark: each micro-batch
updates one row of state for each path. Non-matches are stateless and are
appended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import COUNTS, bulk, derived


def running_totals(long: DataFrame) -> DataFrame:
    """Sums of every path over all that has arrived; for complete or update output."""
    return bulk(long)


def windowed_totals(long: DataFrame, time: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sums of every path in event-time windows; rows later than ``late`` are left out."""
    held = long.withWatermark(time, late)
    return held.groupBy(F.window(time, window).alias("window"), "path").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])


def start(totals: DataFrame, name: str, checkpoint: str, mode: str = "complete", sink: str = "memory", path: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Run a streaming aggregate; the checkpoint folder keeps its state across restarts."""
    writer = totals.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", checkpoint).format(sink)
    writer = writer.option("path", path) if path else writer
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def each_batch(totals: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand the derived metrics of each update to ``write``."""
    return totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, k: write(derived(df), k)).trigger(availableNow=True).start()
