"""Variants near peaks, and the windows that score them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.functions import sequences as S
from lociflow.operators import intervals
from lociflow.sources import genomic


def assign(variants: DataFrame, peaks: DataFrame, folds: DataFrame, margin: int) -> DataFrame:
    """Variants whose nearest peak is at most ``margin`` away, with its distance and strand and the chromosome's fold;
    chromosomes without a fold fall away."""
    targets = peaks.select("chrom", F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("strand").alias("strand2"))
    near = intervals.nearest(variants, targets, ["chrom"]).where(F.col("distance") <= margin)
    return near.withColumnRenamed("distance", "peak_distance").join(folds, "chrom")


def windows_for(assigned: DataFrame, tiled: DataFrame, size: int, shifts: Sequence[int], tile: int = genomic.TILE) -> DataFrame:
    """One row per variant and shift with the RNA of both alleles, seq_ref and seq_alt.

    The window of ``size`` is centred on the variant and moved by the shift. Windows out of range, with N, or whose
    genome base is not the reference base are left out.
    """
    half = size // 2
    spread = assigned.withColumn("shift_idx", F.explode(F.array(*map(F.lit, range(len(shifts))))))
    shift = F.element_at(F.array(*map(F.lit, shifts)), F.col("shift_idx") + 1)
    spread = spread.withColumn("start", F.col("pos") - half + shift).withColumn("end", F.col("pos") + half + 1 + shift).withColumn("id", F.concat_ws("|", "vid", "chrom", "pos", "ref", "alt", "shift_idx"))
    cut = genomic.fetch(spread, tiled, tile).where(F.col("seq").isNotNull() & ~F.col("seq").contains("N"))
    at = (F.col("pos") - F.col("start")).cast("int")
    cut = cut.where(F.substring(F.col("seq"), at + 1, F.lit(1)) == F.col("ref"))
    changed = F.concat(F.substring(F.col("seq"), F.lit(1), at), F.col("alt"), F.substring(F.col("seq"), at + 2, F.lit(size)))
    return cut.withColumns({"seq_ref": S.to_rna(F.col("seq"), F.col("strand")), "seq_alt": S.to_rna(changed, F.col("strand"))}).drop("id", "seq", "start", "end")


def collapse(scored: DataFrame, delta: str, how: str = "max_abs") -> DataFrame:
    """One delta per variant over its shifts: that of largest magnitude, signed, the first of equals; or the mean magnitude.
    NaN is missing; a variant without a number has null."""
    value = F.nanvl(F.col(delta), F.lit(None).cast("double"))
    best = F.max_by(value, F.struct(F.abs(value), -F.col("shift_idx"))) if how == "max_abs" else F.avg(F.abs(value))
    return scored.groupBy("vid").agg(best.alias(delta))
