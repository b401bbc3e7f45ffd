"""Fold assignment, roles and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def role(fold: Column, test: int, k: int) -> Column:
    """test for fold ``test``, val for the next one modulo k, train for the rest."""
    if not 0 <= test < k or k < 3:
        raise ValueError("the test fold must be one of at least three")
    return F.when(fold == test, F.lit("test")).when(fold == (test + 1) % k, F.lit("val")).otherwise(F.lit("train"))


def balanced_folds(masses: Sequence[tuple[str, float]], k: int) -> dict[str, int]:
    """Units to folds, largest first into the lightest; ties by name, then by fold. The units are few, as chromosomes are."""
    if len(masses) < k:
        raise ValueError("fewer units than folds")
    load = [0.0] * k
    found = {}
    for name, mass in sorted(masses, key=lambda m: (-m[1], m[0])):
        at = min(range(k), key=lambda f: (load[f], f))
        found[name], load[at] = at, load[at] + mass
    return found


def fold_of(df: DataFrame, unit: str, folds: dict[str, int]) -> DataFrame:
    """Adds ``fold``; a unit without one fails the job."""
    known = F.coalesce(*[F.when(F.col(unit) == u, F.lit(f)) for u, f in folds.items()])
    return df.withColumn("fold", F.coalesce(known, F.raise_error(F.concat(F.lit("no fold for "), F.coalesce(F.col(unit).cast("string"), F.lit("null")))).cast("int")))


def straddling(df: DataFrame, unit: str, fold: str) -> DataFrame:
    """Units that lie in more than one fold."""
    return df.groupBy(unit).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")


def usable(df: DataFrame, fold: str, label: str, k: int) -> DataFrame:
    """Whether all k folds are there and have both classes."""
    per = df.groupBy(fold).agg(F.count_distinct(label).alias("classes"))
    return per.agg((F.count(F.lit(1)) == k).alias("complete"), (F.min("classes") >= 2).alias("both_classes"))


def drop_pairs(df: DataFrame, pair: str, keep: Column) -> DataFrame:
    """Rows of the pairs of which every member satisfies ``keep``."""
    return df.join(df.where(~F.coalesce(keep, F.lit(False))).select(pair).distinct(), pair, "left_anti")


def fold_shares(df: DataFrame, fold: str, k: int) -> DataFrame:
    """Share of each fold, empty ones included."""
    every = df.sparkSession.range(k).select(F.col("id").cast("int").alias(fold))
    counts = df.groupBy(F.col(fold).cast("int").alias(fold)).agg(F.count(F.lit(1)).alias("n"))
    full = every.join(counts, fold, "left").fillna({"n": 0})
    return full.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))  # k rows
