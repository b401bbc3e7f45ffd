"""Readers of the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table below ``root``. TIMESTAMP_NTZ columns are cast to TIMESTAMP, which the epoch functions accept."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})
