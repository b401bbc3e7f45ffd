"""What a score adds over base features, with scores that saw the outer test fold and with scores that did not.

Out-of-fold scores are clean for the row itself, but the rows that a nested model is trained on were scored by models that saw the
outer test fold. Cross-fitted scores come from models that left out both folds. All outer folds, score sizes and regimes are groups
of one batched fit, so that a Newton step is one pass over the rows whatever their number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.operators import grouped_fits, rankstats, sparse_models
from lociflow.sources.scratch import Scratch, join_same


def outer_scores(rows: DataFrame, by: Sequence[str], features: Sequence[str], label: str, l2: float = 1.0, scratch: Scratch | None = None) -> DataFrame:
    """The rows whose ``fold`` is their ``outer`` fold, with ``oof``: the predictor of the ridge model of their group that was fitted
    on the outer fold's other rows. Null where these have one class."""
    scratch = scratch or Scratch(rows.sparkSession)
    fits = grouped_fits.fit_groups(rows.where("fold <> outer"), [*by, "outer"], features, label, {"m": (features, [])}, firth=False, l2=l2, scratch=scratch)
    tested = join_same(rows.where("fold = outer"), fits.select(*by, "outer", "beta"), [*by, "outer"], "left")
    terms = [F.get("beta", F.lit(i + 1)) * F.col(c) for i, c in enumerate(features)]
    return tested.withColumn("oof", sum(terms, F.get("beta", F.lit(0)))).drop("beta")


def contributions(margins: DataFrame, base: DataFrame, features: Sequence[str], folds: int, l2: float = 1.0, scratch: Scratch | None = None) -> DataFrame:
    """Per group of ``margins``: auroc_base, of the base features alone out of fold, and gain_published and gain_crossfit, what the
    out-of-fold scores and the cross-fitted ones add to it.

    ``margins`` are of the models of ``leave_out(folds, 2)``, ``base`` has row and ``features``. Features and scores are z-scores over
    all rows of a group and outer fold. Rows with a null feature or score are left out of every model of their group.
    """
    scratch = scratch or Scratch(margins.sparkSession)
    crossed = sparse_models.cross_fitted(margins, folds).withColumnRenamed("score", "crossfit")
    own = sparse_models.out_of_fold(margins).select("row", "group", F.col("score").alias("published"))
    both = crossed.join(own, ["row", "group"]).join(base.select("row", *features), "row")
    both = both.where(F.col("crossfit").isNotNull() & F.col("published").isNotNull())
    scores = [F.struct(F.lit(n).alias("regime"), c.alias("_score")) for n, c in (("base", F.lit(0.0)), ("published", F.col("published")), ("crossfit", F.col("crossfit")))]
    long = both.select("row", "group", "fold", "label", "outer", *features, F.explode(F.array(*scores)).alias("s")).select("*", "s.*").drop("s")
    long = scratch.keep(grouped_fits.standardised(long, ["group", "regime", "outer"], [*features, "_score"]), "long")
    tested = outer_scores(long, ["group", "regime"], [*features, "_score"], "label", l2, scratch)
    found = rankstats.auroc(tested, "oof", "label", ["group", "regime"])
    of = lambda r: F.max(F.when(F.col("regime") == r, F.col("auroc")))  # noqa: E731  one row of each regime
    wide = found.groupBy("group").agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), of("base").alias("auroc_base"), of("published").alias("_p"), of("crossfit").alias("_c"))
    return wide.select("group", "n_pos", "n_neg", "auroc_base", (F.col("_p") - F.col("auroc_base")).alias("gain_published"), (F.col("_c") - F.col("auroc_base")).alias("gain_crossfit"))
