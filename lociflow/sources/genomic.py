"""Readers of genomic text formats into typed tables. Compression follows the file suffix; globs read many files at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions import sequences as S

#: Bases of one genome tile.
TILE = 10_000


def _fields(spark: SparkSession, path: str, least: int) -> DataFrame:
    """Tab-separated rows as an array, without blank, comment and track lines and rows of fewer fields."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    kept = lines.where(~F.col("value").rlike(r"^\s*$|^#|^track"))
    return kept.select(F.split("value", "\t").alias("f"), "file").where(F.size("f") >= least)


def _number(i: int, kind: str = "long"):
    return F.expr(f"try_cast(f[{i}] AS {kind})")


def peaks(spark: SparkSession, path: str) -> DataFrame:
    """narrowPeak intervals with signal and p-value (null where absent); the protein is the file name up to its first dot."""
    f = F.col("f")
    rows = _fields(spark, path, 6).select(
        F.substring_index("file", ".", 1).alias("protein"), f[0].alias("chrom"), _number(1).alias("start"), _number(2).alias("end"), f[5].alias("strand"), _number(6, "double").alias("signal"), _number(7, "double").alias("pval")
    )
    return rows.where("start IS NOT NULL AND end IS NOT NULL").withColumn("mid", F.floor((F.col("start") + F.col("end")) / 2))


def annotation(spark: SparkSession, path: str, features: tuple[str, ...] = ("exon", "CDS", "UTR")) -> DataFrame:
    """GTF features of the wanted kinds, 1-based closed turned into 0-based half-open."""
    f = F.col("f")
    rows = _fields(spark, path, 9).where(f[2].isin(*features))
    names = {c: S.attribute(f[8], c) for c in ("transcript_id", "gene_id", "gene_name")}
    return rows.select(f[0].alias("chrom"), f[2].alias("feature"), (_number(3) - 1).alias("start"), _number(4).alias("end"), f[6].alias("strand"), *[v.alias(k) for k, v in names.items()])


def variants(spark: SparkSession, path: str, pathogenic: tuple[str, ...], benign: tuple[str, ...], noncoding: tuple[str, ...] | None = None) -> DataFrame:
    """Single-base variants of a VCF with a wanted significance: label 1 or 0, 0-based pos beside the file's own."""
    f = F.col("f")
    rows = _fields(spark, path, 8).select(
        f[2].alias("vid"), S.normalise_chromosome(f[0]).alias("chrom"), _number(1).alias("pos_vcf"), F.upper(f[3]).alias("ref"), F.upper(f[4]).alias("alt"), S.info_field(f[7], "CLNSIG").alias("clnsig"),
        S.consequences(f[7]).alias("terms"), S.info_field(f[7], "CLNVC").alias("kind"), F.substring_index(S.info_field(f[7], "GENEINFO"), ":", 1).alias("gene"),
    )
    snv = F.col("ref").rlike("^[ACGT]$") & F.col("alt").rlike("^[ACGT]$") & (F.col("ref") != F.col("alt")) & (F.coalesce("kind", F.lit("single_nucleotide_variant")) == "single_nucleotide_variant")
    rows = rows.where(snv & F.col("clnsig").isin(*pathogenic, *benign) & F.col("pos_vcf").isNotNull())
    if noncoding:
        rows = rows.where(F.arrays_overlap("terms", F.array(*map(F.lit, noncoding))))
    return rows.select("vid", "chrom", (F.col("pos_vcf") - 1).alias("pos"), "pos_vcf", "ref", "alt", "clnsig", F.col("clnsig").isin(*pathogenic).cast("int").alias("label"), F.array_join("terms", ",").alias("consequence"), "gene")


def tiles(sequences: DataFrame, size: int = TILE) -> DataFrame:
    """(chrom, seq) as tiles (chrom, tile, seq), so that windows join instead of holding a genome."""
    spots = F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / size).cast("int")))
    return sequences.where(F.length("seq") > 0).select("chrom", "seq", spots.alias("tile")).select("chrom", F.col("tile").cast("long").alias("tile"), F.upper(F.expr(f"substring(seq, tile * {size} + 1, {size})")).alias("seq"))


def fetch(windows: DataFrame, tiled: DataFrame, size: int = TILE, out: str = "seq") -> DataFrame:
    """Adds the upper-case sequence of [start, end) to windows that are unique by ``id``; null out of bounds."""
    need = windows.select("id", "chrom", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("tile"))
    parts = need.join(tiled, ["chrom", "tile"]).select("id", F.col("end") - F.col("start"), "tile", F.expr(f"substring(seq, greatest(start - tile * {size}, 0) + 1, least(end - tile * {size}, {size}) - greatest(start - tile * {size}, 0))").alias("piece")).toDF("id", "n", "tile", "piece")
    whole = parts.groupBy("id", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "piece"))), lambda t: t["piece"]), "").alias(out))
    return windows.join(whole.where(F.length(out) == F.col("n")).drop("n"), "id", "left")


def scores(spark: SparkSession, path: str) -> DataFrame:
    """Positional scores, tab-separated (chrom, pos, value); NaN is missing."""
    rows = _fields(spark, path, 3)
    return rows.select(F.col("f")[0].alias("chrom"), _number(1).alias("pos"), F.nanvl(_number(2, "double"), F.lit(None).cast("double")).alias("value"))


def annotate(df: DataFrame, values: DataFrame, chrom: str = "chrom", pos: str = "pos_vcf", out: str = "conservation") -> DataFrame:
    """Left join of a positional score."""
    return df.join(values.select(F.col("chrom").alias(chrom), F.col("pos").alias(pos), F.col("value").alias(out)), [chrom, pos], "left")


def experiments(spark: SparkSession, path: str) -> DataFrame:
    """Saved search responses with an ``@graph`` array of experiments, one row each."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("@graph").alias("e")).select("e.*")


def best_file(df: DataFrame, key: str) -> DataFrame:
    """Per experiment the file with most replicates; the preferred one wins ties, then the smaller accession."""
    files = df.select(key, F.explode("files").alias("x"))
    order = F.struct(F.size("x.biological_replicates"), F.coalesce("x.preferred_default", F.lit(False)))
    ranked = files.groupBy(key).agg(F.max(order).alias("o")).join(files.withColumn("o", order), [key, "o"])
    return ranked.groupBy(key).agg(F.min("x.accession").alias("accession"))
