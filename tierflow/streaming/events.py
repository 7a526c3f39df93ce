"""Error events as a stream: each event once, though deliveries overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def once(events: DataFrame, arrived_at: str, remembered: str, event_id: str = "error_event_id") -> DataFrame:
    """A stream of events without those whose id arrived before, up to `remembered` (an interval) earlier.

    The ids seen are state, by id, and are dropped when the watermark of the arrival times passes
    them, so the state is bounded by what arrives within that interval.
    """
    return events.withWatermark(arrived_at, remembered).dropDuplicatesWithinWatermark([event_id])


def log_once(events: DataFrame, path: str, checkpoint: str, arrived_at: str, remembered: str) -> StreamingQuery:
    """Append the events that arrived since the last call to the log at `path`, each once."""
    writer = once(events, arrived_at, remembered).writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
