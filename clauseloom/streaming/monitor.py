"""Probe series: the same windowed summary in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(events: DataFrame, width: str = "10 minutes") -> DataFrame:
    """window_start, event_type, probes, failures, mean and longest value of each window; errors are failures."""
    return (
        events.groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("probes"), F.count_if(F.col("event_type") == "error").alias("failures"), F.avg("value").alias("mean_value"), F.max("value").alias("longest"))
        .select(F.col("window.start").alias("window_start"), "event_type", "probes", "failures", "mean_value", "longest")
    )


def stream(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """summary over a stream; rows later than the watermark are dropped."""
    # a watermark needs a timestamp with a zone; the session's is UTC
    return summary(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), width)
