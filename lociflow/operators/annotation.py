"""Region classes of transcripts, from exon, CDS and UTR features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.operators import intervals

TRANSCRIPT = ["chrom", "strand", "transcript_id"]


def split_utrs(features: DataFrame) -> DataFrame:
    """UTRs as utr5 or utr3, by their side of the transcript's coding part and its strand; none without a coding part."""
    coding = features.where("feature = 'CDS'").groupBy(*TRANSCRIPT).agg(F.min("start").alias("c0"), F.max("end").alias("c1"))
    utrs = features.where("feature = 'UTR'").join(coding, TRANSCRIPT)
    before, after = F.col("end") <= F.col("c0"), F.col("start") >= F.col("c1")
    side = F.when(before, F.when(F.col("strand") == "+", "utr5").otherwise("utr3")).when(after, F.when(F.col("strand") == "+", "utr3").otherwise("utr5"))
    return utrs.select(*TRANSCRIPT, side.alias("region"), "start", "end").where("region IS NOT NULL")


def introns(features: DataFrame) -> DataFrame:
    return intervals.gaps(features.where("feature = 'exon'"), TRANSCRIPT).withColumn("region", F.lit("intron"))


def region_index(features: DataFrame) -> DataFrame:
    """Disjoint intervals per region class and chromosome over all transcripts; exons count apart where nothing codes."""
    coding = features.where("feature = 'CDS'")
    exons = features.where("feature = 'exon'").join(coding.select(*TRANSCRIPT).distinct(), TRANSCRIPT, "left_anti").withColumn("region", F.lit("exon_nc"))
    columns = ["region", "chrom", "start", "end"]
    parts = [split_utrs(features), coding.withColumn("region", F.lit("cds")), exons, introns(features)]
    pooled = parts[0].select(*columns)
    for part in parts[1:]:
        pooled = pooled.unionByName(part.select(*columns))
    return intervals.merge(pooled.where("start < end"), ["region", "chrom"])
