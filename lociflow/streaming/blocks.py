"""A streaming form of the tumbling block counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of events as they arrive in a folder."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(folder)


def block_counts(events: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Counts per block of event time and type; rows later than ``late`` behind the newest fall away with their block's state."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return windows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("block"), "event_type", "n", "total")
