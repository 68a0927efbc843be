"""Streaming bars: late events within a watermark, windowed OHLCV, append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream_bars(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """symbol, ts, open, high, low, close, volume of a stream of events; a bar comes when no event of it is awaited.

    Works on batch input too, where the watermark has no effect.
    """
    # min_by and max_by keep one value a bar, so the state does not grow with the events
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return (
        timed.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("symbol"))
        .agg(
            F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )
