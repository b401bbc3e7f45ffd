"""Grouped summaries: concentration, shares, trimmed and paired statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

By = Sequence[str]


def gini(df: DataFrame, value: str, by: By = ()) -> DataFrame:
    """Gini coefficient of absolute values per group, 0 where their sum is 0. Equal values are counted first, so that
    the window holds distinct values alone."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.abs(F.col(value)).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(*by).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_before", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    # the sum of the ranks of n ties that follow b values is n b + n (n + 1) / 2
    rank_sum = F.sum(F.col("_x") * (F.col("_n") * F.col("_before") + F.col("_n") * (F.col("_n") + 1) / 2))
    n, total = F.sum("_n"), F.sum(F.col("_x") * F.col("_n"))
    return ranked.groupBy(*by).agg(n.alias("n"), F.when(total == 0, F.lit(0.0)).otherwise(2 * rank_sum / (n * total) - (n + 1) / n).alias("gini"))


def shares(df: DataFrame, by: By, category: str) -> DataFrame:
    """n and share of each category within its group."""
    counts = df.groupBy(*by, category).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def shares_wide(df: DataFrame, by: By, category: str, values: Sequence[str]) -> DataFrame:
    """One column of shares per value, 0 for absent ones."""
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(*[(F.sum((F.col(category) == v).cast("long")) / n).alias(f"share_{v}") for v in values])


def redundancy(df: DataFrame, key: str, by: By, positive: Column) -> DataFrame:
    """1 - distinct / rows, over all rows and over positives."""
    counted = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_n"), F.sum(positive.cast("long")).alias("_p"))
    return counted.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        (1 - F.count(F.lit(1)) / F.sum("_n")).alias("redundancy"),
        (1 - F.sum((F.col("_p") > 0).cast("long")) / F.nullif(F.sum("_p"), F.lit(0))).alias("redundancy_pos"),
    )


def effect_size(df: DataFrame, value: str, label: str, by: By = ()) -> DataFrame:
    """Cohen's d of label 1 against 0 with the pooled sample variance, and the standardised mean difference."""
    side = lambda k: F.when(F.col(label) == k, F.col(value))
    g = df.groupBy(*by).agg(*[f(side(k)).alias(f"{n}{k}") for k in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2)
    diff = F.col("m1") - F.col("m0")
    return g.select(*by, "n0", "n1", (diff / F.sqrt(pooled)).alias("d"), (diff / F.sqrt((F.col("v0") + F.col("v1")) / 2)).alias("smd"))


def trimmed_mean(df: DataFrame, value: str, by: By, share: float = 0.1) -> DataFrame:
    """Mean without the floor(share n) smallest and largest values of each group."""
    w = Window.partitionBy(*by)
    ranked = df.where(F.col(value).isNotNull()).select(*by, value, F.row_number().over(w.orderBy(value)).alias("_r"), F.count(F.lit(1)).over(w).alias("_n"))
    cut = F.floor(F.col("_n") * F.lit(share))
    return ranked.where((F.col("_r") > cut) & (F.col("_r") <= F.col("_n") - cut)).groupBy(*by).agg(F.avg(value).alias("trimmed_mean"))


def quantiles(df: DataFrame, value: str, by: By, points: Sequence[float]) -> DataFrame:
    """Exact linear quantiles, one column each."""
    return df.groupBy(*by).agg(*[F.percentile(value, F.lit(p)).alias(f"q{round(p * 100):02d}") for p in points])


def leave_one_out(df: DataFrame, value: str, by: By) -> DataFrame:
    """Adds ``rate``: the mean of the others of the group, null where a row is alone."""
    w = Window.partitionBy(*by)
    n = F.count(value).over(w)
    return df.withColumn("rate", (F.sum(value).over(w) - F.col(value)) / F.nullif(n - 1, F.lit(0)))


def largest_magnitude(df: DataFrame, key: By, value: str, order: str) -> DataFrame:
    """Per key the value of largest magnitude, signed; NaN counts as missing, ties go to the earliest by ``order``."""
    clean = df.withColumn(value, F.nanvl(F.col(value), F.lit(None).cast("double")))
    return clean.groupBy(*key).agg(F.max_by(value, F.struct(F.abs(value), -F.col(order))).alias(value))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mutual information in bits of two categories, at least 0."""
    joint = df.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    px, py = joint.groupBy(x).agg(F.sum("n").alias("nx")), joint.groupBy(y).agg(F.sum("n").alias("ny"))
    total = joint.agg(F.sum("n").alias("t"))
    terms = joint.join(px, x).join(py, y).crossJoin(F.broadcast(total))  # one row
    return terms.agg(F.greatest(F.lit(0.0), F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny"))))).alias("mi"))


def top_share(df: DataFrame, value: str, by: By, k: int) -> DataFrame:
    """Share of the positive total that the k largest values hold."""
    w = Window.partitionBy(*by).orderBy(F.desc(value))
    positive = df.where(F.col(value) > 0)
    top = positive.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(*by).agg(F.sum(value).alias("_top"))
    return positive.groupBy(*by).agg(F.sum(value).alias("_all")).join(top, list(by)).select(*by, (F.col("_top") / F.col("_all")).alias("share"))


def with_all(df: DataFrame, group: str, aggregates: Sequence[Column]) -> DataFrame:
    """The aggregates per group and, under ALL, over everything."""
    return df.groupingSets([[group], []], group).agg(*aggregates, F.grouping_id().alias("_g")).withColumn(group, F.when(F.col("_g") == 1, F.lit("ALL")).otherwise(F.col(group))).drop("_g")
