"""Streaming twin of the bars: event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes", symbol: str = "event_type", ts: str = "ts", price: str = "value", tie: str = "event_id") -> DataFrame:
    """Bars of a stream of ticks, in append mode each when the watermark passes its end; later ticks are dropped by event time."""
    at = F.struct("_ts", tie)
    return (
        ticks.withColumn("_ts", F.col(ts).cast("timestamp"))
        .withWatermark("_ts", late)
        .groupBy(F.col(symbol).alias("symbol"), F.window("_ts", width).alias("w"))
        .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("volume"))
        .select("symbol", F.col("w.start").alias("bar_ts"), "open", "high", "low", "close", "volume")
    )
