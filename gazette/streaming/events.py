"""The event log as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_week


def weekly(events: DataFrame, lateness: str = "7 days", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts by ISO week and kind. Weeks start on Monday; later events than `lateness` allows are left out."""
    week = F.window(ts, "7 days", "7 days", "4 days")  # windows are counted from Thursday, 1 January 1970
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    counts = stamped.groupBy(week, by).agg(F.count("*").alias("events"))
    return counts.select(iso_week(F.col("window.start")).alias("iso_week"), by, "events")


def unseen(stream: DataFrame, key: str, ts: str, horizon: str) -> DataFrame:
    """Each key once within a horizon of event time."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


def incremental(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]):
    """Run step(batch, number) over everything that has landed, then stop: replay and catching up are the same."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
