"""Summaries of labelled, paired and split panels of windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.operators.graphs import gram_hashes
from lociflow.operators.ordinals import percentiles
from lociflow.sources.scratch import Scratch, join_same


def _mean(total: str, n: str) -> Column:
    return F.col(total) / F.nullif(F.col(n), F.lit(0))


def panel_summary(df: DataFrame, by: str, pair: str, label: str, role: str, value: str, region: str) -> DataFrame:
    """Per group of ``by``: pairs, shares of the roles, means of ``value`` per class, mean and 95th percentile of the gap
    within pairs, and the most frequent region (ties by name) with its share.

    Rows are reduced to pairs before the group's own aggregate. A pair without both classes has no gap.
    """
    hit, v = F.col(label) == 1, F.col(value)
    count_if = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    roles = ("train", "val", "test")
    pairs = df.groupBy(by, pair).agg(
        F.count(F.lit(1)).alias("n"), *[count_if(F.col(role) == r).alias(f"n_{r}") for r in roles],
        F.sum(F.when(hit, v)).alias("sp"), F.count(F.when(hit, v)).alias("np"), F.sum(F.when(~hit, v)).alias("sn"), F.count(F.when(~hit, v)).alias("nn"),
    )
    gap = F.abs(_mean("sp", "np") - _mean("sn", "nn"))
    wide = pairs.groupBy(by).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_pairs"), *[(F.sum(f"n_{r}") / F.sum("n")).alias(f"share_{r}") for r in roles],
        (F.sum("sp") / F.nullif(F.sum("np"), F.lit(0))).alias("mean_pos"), (F.sum("sn") / F.nullif(F.sum("nn"), F.lit(0))).alias("mean_neg"),
        F.avg(gap).alias("gap_mean"), F.percentile(gap, F.lit(0.95)).alias("gap_p95"),
    )
    regions = df.groupBy(by, region).agg(F.count(F.lit(1)).alias("n"))
    top = regions.groupBy(by).agg(F.min_by(region, F.struct(-F.col("n"), F.col(region))).alias("top_region"), (F.max("n") / F.sum("n")).alias("top_share"))
    return wide.join(top, by)


def motif_enrichment(df: DataFrame, by: Sequence[str], label: str, seq: str, motifs: Sequence[str]) -> DataFrame:
    """Per group and motif the share of positives and of negatives that contain it, and their ratio, infinite where no
    negative does. One pass for all motifs."""
    hit = F.col(label) == 1
    share = lambda m, c: F.avg(F.when(c, F.contains(F.col(seq), F.lit(m)).cast("double")))
    wide = df.groupBy(*by).agg(*[F.struct(F.lit(m).alias("motif"), share(m, hit).alias("pos"), share(m, ~hit).alias("neg")).alias(f"m{i}") for i, m in enumerate(motifs)])
    long = wide.select(*by, F.explode(F.array(*[f"m{i}" for i in range(len(motifs))])).alias("m")).select(*by, "m.*")
    return long.withColumn("ratio", F.when(F.col("neg") == 0, F.lit(float("inf"))).otherwise(F.col("pos") / F.col("neg")))


def split_shift(df: DataFrame, by: str, role: str, value: str, region: str) -> DataFrame:
    """Per group: mean of ``value`` in train minus that in test, and half the L1 distance of their region shares."""
    of = lambda r: F.col(role) == r
    cells = df.groupBy(by, region).agg(*[a for r in ("train", "test") for a in (F.sum(of(r).cast("long")).alias(f"n_{r}"), F.sum(F.when(of(r), F.col(value))).alias(f"s_{r}"))])
    whole = Window.partitionBy(by)
    share = {r: F.col(f"n_{r}") / F.nullif(F.sum(f"n_{r}").over(whole), F.lit(0)) for r in ("train", "test")}
    mean = lambda r: F.sum(f"s_{r}") / F.nullif(F.sum(f"n_{r}"), F.lit(0))
    return cells.withColumn("_d", F.abs(share["train"] - share["test"])).groupBy(by).agg((mean("train") - mean("test")).alias("value_shift"), (F.sum("_d") / 2).alias("region_shift"))


def peak_stats(df: DataFrame, by: str, width: Column, window: int, signal: str, plus: Column) -> DataFrame:
    """Per group: n, whole percentiles and maximum of the widths, share above ``window``, signal percentiles, plus share.

    The percentiles come from counts of distinct values in order, so that no task has all values of a group.
    """
    scratch = Scratch(df.sparkSession)
    df = df.select(by, width.alias("_width"), F.col(signal).alias("_signal"), plus.alias("_plus"))
    plain = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.max("_width").cast("long").alias("width_max"), F.avg((F.col("_width") > window).cast("double")).alias("above"), F.avg(F.col("_plus").cast("double")).alias("plus_share")
    )
    widths = percentiles(df, "_width", [by], {"width_median": 0.5, "width_p10": 0.1, "width_p90": 0.9}, scratch)
    signals = percentiles(df, "_signal", [by], {"signal_median": 0.5, "signal_p90": 0.9}, scratch)
    wide = join_same(join_same(plain, widths, [by], "left"), signals, [by], "left")
    whole = [F.col(c).cast("long").alias(c) for c in ("width_median", "width_p10", "width_p90")]
    return wide.select(by, "n", *whole, "width_max", "above", "signal_median", "signal_p90", "plus_share")


def draw_variance(df: DataFrame, by: str, key: str, value: str, draws: int, one_in: int, salt: str) -> DataFrame:
    """Variance of the group's mean over repeated hashed draws, averaged over groups, beside that between the groups' means.

    Each draw takes one row in ``one_in``; all draws are one pass over the rows.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), F.col("draw"), F.col(key)).cast("binary")), 1, 12), 16, 10).cast("long")
    drawn = df.select(by, key, value, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).where(h % one_in == 0)
    means = drawn.groupBy(by, "draw").agg(F.avg(value).alias("m"))
    groups = means.groupBy(by).agg(F.var_samp("m").alias("within"), F.avg("m").alias("m"))
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.avg("within").alias("between_draws"), F.var_samp("m").alias("between_groups"))


def shared_across_folds(df: DataFrame, key: str, fold: str, grams: str) -> DataFrame:
    """key, fold and the share of the row's distinct grams that another fold has too, for all folds at once: a gram counts if its
    smallest and its largest fold differ. 0 for rows without grams.

    The grams are shuffled once, as hashes; only those that count go back to their rows.
    """
    own = df.select(key, fold, F.array_distinct(F.filter(grams, lambda g: g.isNotNull())).alias("_g"))
    sizes = own.groupBy(key, fold).agg(F.sum(F.greatest(F.lit(0), F.size("_g"))).alias("_n"))
    rows = own.select(key, fold, F.explode(F.transform("_g", gram_hashes)).alias("_g")).select(key, fold, "_g.*")
    same = Window.partitionBy("g", "g2")
    crossing = rows.select(key, fold, F.min(fold).over(same).alias("_lo"), F.max(fold).over(same).alias("_hi")).where("_lo <> _hi")
    hits = crossing.groupBy(key, fold).agg(F.count(F.lit(1)).alias("_hits"))
    return join_same(sizes, hits, [key, fold], "left").select(key, fold, (F.coalesce("_hits", F.lit(0)) / F.greatest("_n", F.lit(1))).alias("share"))


def filter_effect(profile: DataFrame, fold: str, pair: str, cuts: Sequence[float]) -> DataFrame:
    """Per fold: rows, mean share, and for each cut the rows above it and the pairs that lose a member by it."""
    pairs = profile.groupBy(fold, pair).agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("s"), F.max("share").alias("most"), *[F.sum((F.col("share") > c).cast("long")).alias(f"r{i}") for i, c in enumerate(cuts)])
    named = [a for i, c in enumerate(cuts) for a in (F.sum(f"r{i}").alias(f"rows_above_{round(c * 100)}"), F.sum((F.col("most") > c).cast("long")).alias(f"pairs_above_{round(c * 100)}"))]
    return pairs.groupBy(fold).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean_share"), *named)
