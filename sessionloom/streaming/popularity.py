"""Popularity over a stream of events: windows on event time, late events up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sessions import TYPES, count_if


def windowed_popularity(events: DataFrame, window: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """window start and end, item and counts by type, for a streaming or batch event table(ts ms, item, etype)."""
    timed = events.withColumn("time", F.timestamp_millis("ts")).withWatermark("time", late)
    counts = timed.groupBy(F.window("time", window, slide).alias("w"), "item").agg(*(count_if(F.col("etype") == t).alias(t) for t in TYPES), F.count("*").alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "item", *TYPES, "total")


def start(events: DataFrame, path: str, checkpoint: str):
    """Appends closed windows as Parquet; the checkpoint folder makes restarts exact."""
    return windowed_popularity(events).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
