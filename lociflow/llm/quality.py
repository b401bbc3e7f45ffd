"""Quality rules with risk-controlled thresholds.

Rules reject a document whose statistic reaches a cutoff. Labelled good documents are the holdout: in each stratum, a
cutoff is allowed where the exact binomial test refutes that it rejects a share ``alpha / rules`` or more of the good
documents, at the level ``delta`` divided by all tests of the grid (Bonferroni). The strictest allowed cutoff is used.
With probability 1 - delta, then, no stratum loses more than ``alpha`` of its good documents to all rules together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import SPACE, shared_dir, stored, words_of

#: Rule -> (statistic, denominator); the cutoffs of each, in thousandths.
RULES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
CUTOFFS = (50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900)


def _repeat_words(grams: Column) -> Column:
    """Words in 3-word windows found twice or more: sorted windows show repeats as neighbours; the spans of the
    repeated ones are joined in text order."""
    size = F.size(grams)
    ordered = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == size, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(ordered)


def measure(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, the carried columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed.

    A null text has no words. Whole texts are read; nothing is shuffled. Repeated rows are measured each.
    """
    df = docs.select("doc_id", *carried, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = df.withColumn("words", words_of(F.col("text")))
    df = df.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]")),
            "grams": F.when(
                F.size("words") >= 3,
                F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.col("words")[i], F.col("words")[i + 1], F.col("words")[i + 2])),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    ).drop("words", "text")
    df = df.withColumns(
        {
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "sorted": _repeat_words(F.col("grams")),
        }
    ).drop("lines", "grams")
    twin = lambda x, i: (x["h"] == F.get("sorted", i - 1)["h"]) | (x["h"] == F.get("sorted", i + 1)["h"])
    df = df.withColumn("starts", F.array_sort(F.transform(F.filter("sorted", twin), lambda x: x["i"]))).drop("sorted")
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    df = df.withColumn("n_repeat_words", covered.cast("long")).drop("starts")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _reaches(rule: str, cutoff: Column | int) -> Column:
    """Whether the statistic reaches ``cutoff`` thousandths of its denominator, in integers."""
    top, bottom = RULES[rule]
    return (F.col(bottom) > 0) & (1000 * F.col(top) >= cutoff * F.col(bottom))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n draws with probability p, summed term by term in logarithms; 1 where k >= n p, which no
    test below one half passes."""
    first, odds = n * F.lit(math.log1p(-p)), F.lit(math.log(p / (1 - p)))
    step = lambda a, i: F.struct(
        (a["log"] + F.ln((n - i) / (i + 1)) + odds).alias("log"),
        (a["sum"] + F.exp(a["log"] + F.ln((n - i) / (i + 1)) + odds)).alias("sum"),
    )
    terms = F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    summed = F.aggregate(terms, F.struct(first.alias("log"), F.exp(first).alias("sum")), step, lambda a: a["sum"])
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(summed)


def thresholds(measured: DataFrame, labels: DataFrame, stratum: str, alpha: float, delta: float) -> DataFrame:
    """Per stratum, the strictest allowed cutoff of each rule in thousandths (null: none), and the good documents seen.

    A document is good where all its labels of quality are 1. Good documents that fail the base rules are left out, as
    their loss is none of these rules'. Only counts per stratum are kept; the tests run on those.
    """
    good = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_q")).where("_q = 1").select("doc_id")
    seen = measured.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    counts = seen.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("n_good"),
        *[F.sum(_reaches(r, c).cast("long")).alias(f"{r}_{c}") for r in RULES for c in CUTOFFS],
    )
    strata = counts.agg(F.count(F.lit(1)).alias("_strata"))
    level = F.lit(delta) / (F.col("_strata") * len(RULES) * len(CUTOFFS))
    tested = counts.crossJoin(F.broadcast(strata))  # one row
    share = alpha / len(RULES)
    best = lambda r: F.array_min(F.filter(F.array(*[F.when(binomial_tail(F.col(f"{r}_{c}"), F.col("n_good"), share) <= level, F.lit(c)) for c in CUTOFFS]), lambda x: x.isNotNull()))
    return tested.select(stratum, "n_good", *[best(r).alias(f"cut_{r}") for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.06, delta: float = 0.05, folder: str | None = None) -> DataFrame:
    """Every document with its measures, base_failed, rejected_by and kept.

    ``rejected_by`` names the first rule that rejects, ``base`` before all others, null where kept. A stratum that has
    too few good documents for a test, or none, keeps what the base rules keep; so does a null stratum. Measures are
    stored once, without texts, for both the calibration and the verdict. Empty tables give no rows; an empty label
    table leaves the base rules alone. Columns of other names are not read.
    """
    source = docs.select("doc_id", "text", F.col(stratum).cast("string").alias("stratum"))
    measured = stored(measure(source, "stratum"), folder or shared_dir(docs.sparkSession), "measured")
    cuts = thresholds(measured, labels, "stratum", alpha, delta)
    judged = measured.join(cuts.drop("n_good"), "stratum", "left")
    first = F.when(F.col("base_failed"), F.lit("base"))
    for r in RULES:
        first = first.when(F.coalesce(_reaches(r, F.col(f"cut_{r}")), F.lit(False)), F.lit(r))
    return judged.withColumn("rejected_by", first).withColumn("kept", F.col("rejected_by").isNull()).drop("stratum", *[f"cut_{r}" for r in RULES])
