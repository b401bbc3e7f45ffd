"""Paired AUROC comparison, correlations and intervals as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions.sequences import normal_tail
from lociflow.operators.rankstats import midrank


def placements(counts: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    """by..., score, and _pos and _neg: the share of the other class that a positive or negative row of that score beats, ties half.

    ``counts`` has the rows _p and _n of each class; only distinct scores are ranked.
    """
    at = counts.groupBy(*by, score).agg(F.sum("_p").alias("_ps"), F.sum("_n").alias("_ns"))
    below = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    share = lambda c: (F.coalesce(F.sum(c).over(below), F.lit(0)) + F.col(c) / F.lit(2.0)) / F.nullif(F.sum(c).over(whole), F.lit(0))
    return at.select(*by, score, share("_ns").alias("_pos"), (1 - share("_ps")).alias("_neg"))


def auroc_interval(df: DataFrame, score: str, label: str, by: Sequence[str] = (), z: float = 1.959963984540054, scale: str = "linear") -> DataFrame:
    """by..., n_pos, n_neg, auc, its standard error and the interval of ``z`` errors around it, within 0 and 1; on the ``logit``
    scale it lies within these by itself, unless the error is 0 or the AUROC 0 or 1.

    Rows are first counted per distinct score; the variances of the placements in each class have n - 1 and are weighted by
    those counts. Null scores and labels are left out; a class of fewer than two rows gives no error.
    """
    by = list(by)
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = rows.groupBy(*by, score).agg(F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) != 1).cast("long")).alias("_n"))
    below = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    share = lambda c: (F.coalesce(F.sum(c).over(below), F.lit(0)) + F.col(c) / F.lit(2.0)) / F.nullif(F.sum(c).over(whole), F.lit(0))
    placed = counts.select(*by, "_p", "_n", share("_n").alias("_pos"), (1 - share("_p")).alias("_neg"))
    # shifted by a half, around which placements lie, before they are squared
    at = {"_p": F.col("_pos") - 0.5, "_n": F.col("_neg") - 0.5}
    sums = [s for w, v in at.items() for s in (F.sum(w).alias(f"n{w}"), F.sum(F.col(w) * v).alias(f"x{w}"), F.sum(F.col(w) * v * v).alias(f"xx{w}"))]
    g = placed.groupBy(*by).agg(*sums)
    variance = lambda w: (F.col(f"xx{w}") - F.col(f"x{w}") ** 2 / F.col(f"n{w}")) / F.nullif((F.col(f"n{w}") - 1) * F.col(f"n{w}"), F.lit(0))
    g = g.withColumn("auc", F.col("x_p") / F.nullif(F.col("n_p"), F.lit(0)) + 0.5).withColumn("se", F.sqrt(F.greatest(variance("_p"), F.lit(0.0)) + F.greatest(variance("_n"), F.lit(0.0))))
    g = g.withColumn("se", F.when((F.col("n_p") > 1) & (F.col("n_n") > 1), F.col("se")))
    if scale == "logit":
        inner = (F.col("se") > 0) & (F.col("auc") > 0) & (F.col("auc") < 1)
        eta, wide = F.ln(F.col("auc") / (1 - F.col("auc"))), z * F.col("se") / (F.col("auc") * (1 - F.col("auc")))
        ends = [F.when(inner, 1 / (1 + F.exp(-(eta + s * wide)))).when(F.col("se").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("auc") + s * z * F.col("se")))) for s in (-1, 1)]
        return g.select(*by, F.col("n_p").alias("n_pos"), F.col("n_n").alias("n_neg"), "auc", "se", ends[0].alias("low"), ends[1].alias("high"))
    return g.select(*by, F.col("n_p").alias("n_pos"), F.col("n_n").alias("n_neg"), "auc", "se", F.when(F.col("se").isNotNull(), F.greatest(F.col("auc") - z * F.col("se"), F.lit(0.0))).alias("low"), F.when(F.col("se").isNotNull(), F.least(F.col("auc") + z * F.col("se"), F.lit(1.0))).alias("high"))


def delong(df: DataFrame, one: str, two: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """AUROCs of two scores on the same rows, their difference, its standard error, z and two-sided p.

    Rows are first counted per pair of scores. The covariance comes from the variances of the placements in each class with
    n - 1, weighted by those counts; p is 1 where it is 0.
    """
    by = list(by)
    rows = df.where(F.col(one).isNotNull() & F.col(two).isNotNull() & F.col(label).isNotNull())
    key = [F.col(c).alias(f"_b{i}") for i, c in enumerate(by)]
    keys = [f"_b{i}" for i in range(len(by))]
    counts = rows.groupBy(*key, F.col(one).alias("_s1"), F.col(two).alias("_s2")).agg(F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) != 1).cast("long")).alias("_n"))
    placed = counts
    for i in "12":
        ranked = placements(counts, f"_s{i}", keys).withColumnsRenamed({"_pos": f"_pos{i}", "_neg": f"_neg{i}"} | {f"_s{i}": f"_r{i}"} | {k: f"{k}_r{i}" for k in keys})
        on = F.col(f"_s{i}") == F.col(f"_r{i}")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}_r{i}"))
        placed = placed.join(ranked, on).drop(f"_r{i}", *[f"{k}_r{i}" for k in keys])
    each = lambda w, x: F.sum(F.col(w) * x) / F.nullif(F.sum(w), F.lit(0))
    means = placed.groupBy(*keys).agg(
        F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"), each("_p", F.col("_pos1")).alias("auc1"), each("_p", F.col("_pos2")).alias("auc2"), each("_n", F.col("_neg1") - F.col("_neg2")).alias("_mean_neg")
    )
    for k in keys:
        means = means.withColumnRenamed(k, f"{k}_m")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_m"))
    centred = placed.join(means, on)
    spread = lambda w, v, mean, n: F.sum(F.col(w) * (F.col(f"{v}1") - F.col(f"{v}2") - mean) ** 2) / F.nullif(F.first(n) - 1, F.lit(0))
    g = centred.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("n_pos", "n_neg", "auc1", "auc2")],
        spread("_p", "_pos", F.col("auc1") - F.col("auc2"), "n_pos").alias("s10"),
        spread("_n", "_neg", F.col("_mean_neg"), "n_neg").alias("s01"),
    ).withColumnsRenamed(dict(zip(keys, by)))
    se = F.sqrt(F.col("s10") / F.col("n_pos") + F.col("s01") / F.col("n_neg"))
    return (
        g.withColumn("diff", F.col("auc1") - F.col("auc2"))
        .withColumn("se", se)
        .withColumn("z", F.when(F.col("se") > 0, F.col("diff") / F.col("se")).otherwise(F.lit(0.0)))
        .withColumn("p", normal_tail(F.col("z")))
        .drop("s10", "s01")
    )


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with averaged ties."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rows.select(*by, midrank(F.col(x), by).alias("rx"), midrank(F.col(y), by).alias("ry"))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho"))


def partial_correlation(df: DataFrame, x: str, y: str, given: str, by: Sequence[str] = (), least: int = 10) -> DataFrame:
    """Correlation of x and y given a third column; null below ``least`` rows."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("xy"), F.corr(x, given).alias("xz"), F.corr(y, given).alias("yz"))
    value = (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))
    return g.select(*by, "n", F.when(F.col("n") >= least, value).alias("partial"))


def ols(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and residual sum of squares of y on x."""
    g = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    return g.select(*by, "slope", "intercept", (F.col("syy") - F.col("sxy") ** 2 / F.col("sxx")).alias("rss"))


def percentile_interval(draws: DataFrame, value: str, null: float = 0.0) -> DataFrame:
    """2.5 and 97.5 percentiles of bootstrap draws, and the two-sided p of ``null``, at least 1 / draws."""
    n = F.count(F.lit(1))
    below = F.sum((F.col(value) <= null).cast("long"))
    return draws.agg(
        F.percentile(value, F.lit(0.025)).alias("ci_low"),
        F.percentile(value, F.lit(0.975)).alias("ci_high"),
        F.greatest(1 / n, F.least(F.lit(1.0), 2 * F.least(below, n - below) / n)).alias("p"),
    )


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Average precision with equal scores taken together."""
    by = list(by)
    steps = df.groupBy(*by, score).agg(F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    down = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    seen = steps.withColumns({"_tp": F.sum("_p").over(down), "_all": F.sum("_n").over(down)})
    return seen.groupBy(*by).agg((F.sum(F.col("_p") * F.col("_tp") / F.col("_all")) / F.nullif(F.sum("_p"), F.lit(0))).alias("average_precision"))
