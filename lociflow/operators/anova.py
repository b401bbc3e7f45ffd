"""Shares of variance of crossed factors with any number of levels.

Each factor's share is the drop in the residual sum of squares when it joins a least-squares model of all others, over the total. All
models are solved at once by conjugate gradients on the normal equations: rows are first summed per combination of levels, a step
joins the direction's effects with these cells and sums the residuals back per level, and the driver sees one number for each model.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.sources.scratch import Scratch, bounded


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def variance_shares(df: DataFrame, y: str, factors: Sequence[str], steps: int = 200, tolerance: float = 1e-10, scratch: Scratch | None = None) -> DataFrame:
    """factor and share, a row for each factor and one for ``residual``, the full model's residual over the total.

    Rows with a null or NaN ``y`` are left out; a null level is a level. Shares need not sum to 1. Without variation there is no row.
    """
    scratch = scratch or Scratch(df.sparkSession)
    value, m = F.col(y).cast("double"), len(factors)
    k = m + 1  # model i leaves out factor i, the last one is full
    rows = df.where(value.isNotNull() & ~F.isnan(value))
    first = rows.agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).first()
    if not first.n:
        return df.sparkSession.createDataFrame([], "factor string, share double")
    levels = [F.struct(F.col(f).isNull().alias("none"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("level")).alias(f"f{i}") for i, f in enumerate(factors)]
    centred = value - F.lit(first["mean"])
    cells = rows.select(*levels, centred.alias("y")).groupBy(*[f"f{i}" for i in range(m)]).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"))
    cells = scratch.keep(cells.withColumn("e", F.array_repeat(F.col("s") / F.col("n"), k)), "cells")
    total, within = cells.agg(F.sum("ss"), F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n"))).first()
    if total <= 0:
        return df.sparkSession.createDataFrame([], "factor string, share double")

    def back(cells: DataFrame) -> DataFrame:
        """The gradient of each level: its rows' summed residuals, and their number; 0 in the model without the factor."""
        spread = F.explode(F.array(*[F.struct(F.lit(i).alias("factor"), F.col(f"f{i}").alias("level")) for i in range(m)])).alias("at")
        sums = cells.select(spread, "n", "e").groupBy("at").agg(F.sum("n").alias("count"), F.array(*[F.sum(F.col("n") * F.col("e")[i]) for i in range(k)]).alias("g"))
        return sums.withColumn("g", F.transform("g", lambda g, i: F.when(i == F.col("at.factor"), 0.0).otherwise(g)))

    def sizes(levels: DataFrame) -> np.ndarray:
        return np.array([x or 0.0 for x in levels.agg(*[F.sum(F.col("g")[i] * F.col("g")[i] / F.col("count")) for i in range(k)]).first()])

    state = scratch.keep(back(cells).withColumn("p", F.transform("g", lambda g: g / F.col("count"))), "levels")
    now = start = sizes(state)
    for _ in range(steps):
        open_ = now > tolerance**2 * np.maximum(start, 1e-300)
        if not open_.any():
            break
        found, effects = cells.select("n", "ss", *[f"f{i}" for i in range(m)], "e"), bounded(state.select("at", "p"), 64 + 8 * k)
        for i in range(m):
            found = found.join(effects.where(F.col("at.factor") == i).select(F.col("at.level").alias(f"f{i}"), F.col("p").alias(f"p{i}")), f"f{i}")
        added = F.array(*[sum(F.col(f"p{i}")[j] for i in range(m)) for j in range(k)])
        found = scratch.keep(found.select("n", "ss", *[f"f{i}" for i in range(m)], "e", added.alias("q")), "along")
        curved = np.array([x or 0.0 for x in found.agg(*[F.sum(F.col("n") * F.col("q")[i] * F.col("q")[i]) for i in range(k)]).first()])
        length = np.where(open_ & (curved > 0), now / np.where(curved > 0, curved, 1), 0.0)
        cells = found.select("n", "ss", *[f"f{i}" for i in range(m)], F.zip_with("e", F.zip_with("q", _numbers(length), lambda q, t: q * t), lambda e, d: e - d).alias("e"))
        fresh = scratch.keep(back(cells), "gradient")
        after = sizes(fresh)
        turn = np.where(open_ & (now > 0), after / np.where(now > 0, now, 1), 0.0)
        p = F.zip_with(F.transform("g", lambda g: g / F.col("count")), F.zip_with("old", _numbers(turn), lambda o, b: o * b), lambda z, o: z + o)
        state = scratch.keep(fresh.join(state.select("at", F.col("p").alias("old")), "at").withColumn("p", p).drop("old"), "levels")
        now = after
    left = within + np.array([x or 0.0 for x in cells.agg(*[F.sum(F.col("n") * F.col("e")[i] * F.col("e")[i]) for i in range(k)]).first()])
    shares = [(f, float((left[i] - left[m]) / total)) for i, f in enumerate(factors)] + [("residual", float(left[m] / total))]
    return df.sparkSession.createDataFrame(shares, "factor string, share double")
