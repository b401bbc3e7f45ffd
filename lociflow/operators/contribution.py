"""What a score adds over composition: nested models out of fold, likelihood-ratio tests, comparisons of all pairs of scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from math import erfc, exp, gamma, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.operators import models, rankstats, stats


def chi_square_tail(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution for whole degrees of freedom."""
    if x <= 0:
        return 1.0
    h = x / 2
    tail, k = (erfc(sqrt(h)), 0.5) if df % 2 else (exp(-h), 1.0)
    while k < df / 2:  # each two further degrees add one term
        tail += h**k * exp(-h) / gamma(k + 1)
        k += 1
    return min(1.0, tail)


def nested_contribution(df: DataFrame, base: Sequence[str], extra: Sequence[str], label: str, fold: str, folds: int, **options) -> DataFrame:
    """One row: AUROC of the out-of-fold scores without and with ``extra``, the gain with its paired error and p, and the
    out-of-fold log likelihoods, deviance gain and integrated discrimination of the two models.

    Rows of a fold without a model are left out. Both fits are Newton steps over the whole table; no row is collected.
    """
    one = models.out_of_fold(df, list(base), label, fold, folds, **options).withColumnRenamed("oof", "_base")
    both = models.out_of_fold(one, [*base, *extra], label, fold, folds, **options).withColumnRenamed("oof", "_full")
    scored = both.where(F.col("_base").isNotNull() & F.col("_full").isNotNull() & F.col(label).isNotNull())
    p = {c: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(c))))) for c in ("_base", "_full")}
    hit = F.col(label) == 1
    loglik = {c: F.sum(F.when(hit, F.ln(v)).otherwise(F.ln(1 - v))) for c, v in p.items()}
    mean = lambda c, when: F.avg(F.when(when, p[c]))
    fit = scored.agg(
        loglik["_base"].alias("loglik_base"),
        loglik["_full"].alias("loglik_full"),
        (2 * (loglik["_full"] - loglik["_base"])).alias("deviance_gain"),
        ((mean("_full", hit) - mean("_full", ~hit)) - (mean("_base", hit) - mean("_base", ~hit))).alias("discrimination"),
    )
    paired = stats.delong(scored, "_full", "_base", label).select("n_pos", "n_neg", F.col("auc2").alias("auc_base"), F.col("auc1").alias("auc_full"), F.col("diff").alias("gain"), "se", "p")
    return paired.crossJoin(fit)  # one row each


def fit_all(df: DataFrame, features: Sequence[str], label: str, **options) -> DataFrame:
    """``df`` with ``fitted``, the linear predictor of one model on all rows; null where there is one class alone."""
    rows = df.withColumn("_none", F.lit(0))
    betas = models.fit_complements(rows, list(features), label, "_none", 2, **options)
    return df.withColumn("fitted", models._score(betas[1], features) if 1 in betas else F.lit(None).cast("double"))


def likelihood_ratio(df: DataFrame, base: Sequence[str], extra: Sequence[str], label: str, **options) -> DataFrame:
    """One row: log likelihoods of the models without and with ``extra``, twice their difference, its degrees of freedom, p
    and McFadden's share; nulls where there is one class alone. ``l2`` of 0 (the default here) gives the plain test."""
    options.setdefault("l2", 0.0)
    both = fit_all(fit_all(df.where(F.col(label).isNotNull()), base, label, **options).withColumnRenamed("fitted", "_base"), [*base, *extra], label, **options)
    one, two = models.log_likelihood(both, "_base", label).first(), models.log_likelihood(both, "fitted", label).first()  # one row each
    ratio = None if two.loglik is None else 2 * (two.loglik - one.loglik)
    p = None if ratio is None else chi_square_tail(ratio, len(extra))
    row = (one.n, one.loglik, two.loglik, ratio, len(extra), p, None if not one.loglik else 1 - two.loglik / one.loglik)
    return df.sparkSession.createDataFrame([row], "n long, loglik_base double, loglik_full double, ratio double, df int, p double, share double")


def all_pairs(df: DataFrame, scores: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """The paired AUROC test of every two of the few named scores, with ``q`` corrected over the pairs of each group."""
    tests = [stats.delong(df, a, b, label, by).select(F.lit(a).alias("one"), F.lit(b).alias("two"), *by, "auc1", "auc2", "diff", "se", "p") for a, b in combinations(scores, 2)]
    return rankstats.benjamini_hochberg(reduce(DataFrame.unionByName, tests), "p", by)
