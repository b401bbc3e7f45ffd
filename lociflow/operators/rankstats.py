"""Rank statistics: tie-averaged ranks, AUROC, false-discovery correction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def auroc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """AUROC per group from a histogram of distinct scores.

    Rows are first summed per (group, score) with map-side combining, so that ties and hot groups shrink before any
    window: the probability that a positive outranks a negative is the sum over distinct scores of the positives there
    times the negatives below plus half those equal. Null scores or labels are left out; a group of one class gives NULL.
    Returns by..., n_pos, n_neg, auroc.
    """
    by = list(by)
    counts = (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, F.col(score).alias("_s"))
        .agg(F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) != 1).cast("long")).alias("_n"))
    )
    below = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    return summed.groupBy(*by).agg(
        F.sum("_p").alias("n_pos"),
        F.sum("_n").alias("n_neg"),
        (F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / F.lit(2.0))) / F.nullif(F.sum("_p") * F.sum("_n"), F.lit(0))).alias("auroc"),
    )


def midrank(value: Column, by: Sequence[Column | str] = ()) -> Column:
    """Tie-averaged rank of ``value`` inside a group, 1-based."""
    w = Window.partitionBy(*by).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(w) + (ties - 1) / F.lit(2.0)


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``q``: step-up adjusted p-values within each group; NULL stays NULL and does not count as a test."""
    by = list(by)
    tested = F.col(p).isNotNull()
    m = F.sum(tested.cast("long")).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by, tested).orderBy(p))
    upward = Window.partitionBy(*by, "_tested").orderBy(F.desc(p), F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumns({"_tested": tested, "_m": m, "_rank": rank})
        .withColumn("q", F.when(F.col("_tested"), F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(upward))))
        .drop("_tested", "_m", "_rank")
    )
