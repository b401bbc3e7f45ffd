"""Leakage, duplication and integrity audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct grams of a reference up to which every executor gets them all.
BROADCAST_GRAMS = 500_000


def containment(queries: DataFrame, reference: DataFrame, key: str, grams: str) -> DataFrame:
    """Share of each query's distinct grams that the reference has, 0 for a query without grams.

    ``grams`` names an array column on both sides. The reference is reduced to distinct grams before the join; while these
    are few they are broadcast, so that the queries' grams are counted where they are made.
    """
    known = reference.select(F.explode(grams).alias("g")).distinct()
    known = F.broadcast(known) if known.count() <= BROADCAST_GRAMS else known
    own = queries.select(key, F.explode_outer(F.array_distinct(grams)).alias("g"))
    hit = own.join(known.withColumn("_hit", F.lit(1)), "g", "left")
    return hit.groupBy(key).agg((F.coalesce(F.sum("_hit"), F.lit(0)) / F.greatest(F.count("g"), F.lit(1))).alias("share"))


def thresholds(profile: DataFrame, share: str, cuts: Sequence[float] = (0.0, 0.25, 0.5, 0.9)) -> DataFrame:
    """Mean, median, 95th percentile, and the share of rows strictly above each cut."""
    above = [F.avg((F.col(share) > c).cast("double")).alias(f"above_{round(c * 100)}") for c in cuts]
    return profile.agg(F.avg(share).alias("mean"), F.median(share).alias("median"), F.percentile(share, F.lit(0.95)).alias("p95"), *above)


def duplicates(df: DataFrame, coarse: Sequence[str], full: Sequence[str], fold: str, label: str) -> DataFrame:
    """Surplus rows by a coarse and a full key, and full keys that cross folds or mix labels."""
    by_full = df.groupBy(*full).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(fold).alias("f"), F.count_distinct(label).alias("l"))
    by_coarse = df.groupBy(*coarse).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("coarse_surplus"))
    checks = by_full.agg(F.sum(F.col("n") - 1).alias("full_surplus"), F.sum((F.col("f") > 1).cast("long")).alias("cross_fold"), F.sum((F.col("l") > 1).cast("long")).alias("mixed_label"))
    return by_coarse.crossJoin(checks)  # one row each


def profile(df: DataFrame) -> DataFrame:
    """Per column its type, missing, distinct, smallest and largest values as text.

    Each column is reduced to its distinct values and their counts, so that no task sees the whole of one; what remains of these
    is a row for each task before the final one.
    """
    found = []
    for at, (c, t) in enumerate(df.dtypes):
        values = df.groupBy(F.col(f"`{c}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        one = values.agg(F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("missing"), F.count("v").alias("distinct"), F.min("v").cast("string").alias("smallest"), F.max("v").cast("string").alias("largest"))
        found.append(one.select(F.lit(c).alias("column"), F.lit(t).alias("type"), F.coalesce("missing", F.lit(0)).alias("missing"), "distinct", "smallest", "largest"))
    return reduce(DataFrame.unionByName, found)


def compare(old: DataFrame, new: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Rows that differ between two tables with unique keys: added, dropped, or changed beyond the relative tolerance."""
    both = old.select(key, F.col(value).alias("old"), F.lit(True).alias("_o")).join(new.select(key, F.col(value).alias("new"), F.lit(True).alias("_w")), key, "full")
    close = F.abs(F.col("old") - F.col("new")) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(F.col("old")))
    status = F.when(F.col("_o").isNull(), F.lit("added")).when(F.col("_w").isNull(), F.lit("dropped")).when(~F.coalesce(close | (F.col("old") == F.col("new")), F.col("old").isNull() & F.col("new").isNull()), F.lit("changed"))
    return both.withColumn("status", status).where("status IS NOT NULL").drop("_o", "_w")


def digest(df: DataFrame, *columns: str) -> DataFrame:
    """Row count and an order-free content hash: the sum of row hashes, so that it needs one small aggregate."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]).cast("binary")), 1, 12), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("digest"))


def carry_forward(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows, and the old ones whose key has none."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def first_wins(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row per key, the first by ``order``; combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*key, "_r.*")


def invariant(name: str, holds: Column) -> Column:
    """A named check as an aggregate: how many rows break it."""
    return F.sum((~F.coalesce(holds, F.lit(False))).cast("long")).alias(name)
