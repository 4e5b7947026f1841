"""Debouncing file events and re-indexing what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def debounced(events: DataFrame, quiet: str = "2 seconds", late: str | None = "10 seconds") -> DataFrame:
    """(path, started, settled, n_events): one row per burst of events of a path, when it has been quiet for long enough.

    events: (path, ts), a stream or a batch; ts may lack a zone. On a stream the watermark bounds the state: a
    burst is given once it is over and the watermark has passed it; an event that comes more than ``late`` behind
    is dropped and counted in the query's progress (numRowsDroppedByWatermark). None sets no watermark: nothing is
    dropped, bursts are given in update mode and the state grows with the paths.
    """
    rows = events.select("path", F.col("ts").cast("timestamp").alias("ts"))
    if rows.isStreaming and late is not None:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy("path", F.session_window("ts", quiet).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return out.select("path", F.col("w.start").alias("started"), F.col("w.end").alias("settled"), "n_events")


def reindex_stream(bursts: DataFrame, reindex: Callable[[DataFrame], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs ``reindex`` on the distinct paths of each micro-batch; a retried batch repeats the same paths, so replacing per file stays exact."""

    def batch(df: DataFrame, _: int) -> None:
        reindex(df.select("path").distinct())

    writer = bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()
