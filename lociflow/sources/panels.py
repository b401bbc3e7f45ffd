"""Typed tables of a study: its panels, windows, scores and genes."""

from __future__ import annotations

import gzip
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions import sequences as S
from lociflow.sources.genomic import _fields, _number

PANEL = "protein string, cell_line string, pairs long"
SCORES = "id string, label int, fold int, score double"


def panel(spark: SparkSession, path: str, least_pairs: int | None = None) -> DataFrame:
    """protein, cell_line and pairs of panel files (tab-separated with a header); rows below ``least_pairs`` and rows whose number
    does not read as one are left out."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="protein string, cell_line string, pairs string")
    rows = rows.select("protein", "cell_line", F.expr("try_cast(trim(pairs) AS long)").alias("pairs")).where(F.col("protein").isNotNull() & F.col("pairs").isNotNull())
    return rows if least_pairs is None else rows.where(F.col("pairs") >= least_pairs)


def write_panel(candidates: DataFrame, keep: Column, reason: Column, folder: str) -> None:
    """The kept rows below ``panel`` and the others with their reason below ``excluded``, in order of protein and cell line. Rows whose
    condition is null are excluded."""
    ok = F.coalesce(keep, F.lit(False))
    kept = candidates.where(ok).select("protein", "cell_line", "pairs")
    out = candidates.where(~ok).select("protein", "cell_line", "pairs", reason.alias("reason"))
    for df, name in ((kept, "panel"), (out, "excluded")):
        df.orderBy("protein", "cell_line").write.mode("overwrite").csv(f"{folder}/{name}", sep="\t", header=True)


def scores(spark: SparkSession, path: str) -> DataFrame:
    """id, label, fold, score and file of score tables (tab-separated with a header), compressed or not as their first bytes say, not
    their names. Each file is read whole in a task; missing columns and numbers that do not read as such are null."""
    names = [c.split()[0] for c in SCORES.split(", ")]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                text = (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode("utf-8", "replace")
                lines = [line.split("\t") for line in text.splitlines() if line.strip()]
                at = {c: i for i, c in enumerate(lines[0])} if lines else {}
                cell = lambda f, c: f[at[c]] if c in at and at[c] < len(f) and f[at[c]] != "" else None
                for start in range(1, len(lines), 50_000):
                    yield pd.DataFrame([[*[cell(f, c) for c in names], path] for f in lines[start : start + 50_000]], columns=[*names, "file"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(parse, "id string, label string, fold string, score string, file string")
    return rows.select(*[F.expr(f"try_cast({c.split()[0]} AS {c.split()[1]})").alias(c.split()[0]) for c in SCORES.split(", ")], "file")


def genes(spark: SparkSession, path: str, expression: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """chrom, start, end, strand and gid (without version) of the genes of an annotation on the chromosomes 1 to 22, X and Y, and for each
    name in ``expression`` the largest TPM of the gene in its quantification files, null where none has it."""
    f = F.col("f")
    rows = _fields(spark, path, 9).where((f[2] == "gene") & f[0].rlike(r"^chr(\d+|X|Y)$"))
    gid = F.substring_index(S.attribute(f[8], "gene_id"), ".", 1)
    found = rows.select(f[0].alias("chrom"), (_number(3) - 1).alias("start"), _number(4).alias("end"), f[6].alias("strand"), gid.alias("gid")).where(F.col("gid").isNotNull())
    for name, paths in (expression or {}).items():
        tpm = spark.read.csv(list(paths), sep="\t", header=True).select(F.substring_index("gene_id", ".", 1).alias("gid"), F.expr("try_cast(TPM AS double)").alias("tpm"))
        found = found.join(tpm.where(F.col("gid").startswith("ENSG")).groupBy("gid").agg(F.max("tpm").alias(name)), "gid", "left")
    return found.select("chrom", "start", "end", "strand", "gid", *(expression or {}))


def positives(windows: DataFrame, key: Sequence[str] = ("chrom", "start", "end", "strand")) -> DataFrame:
    """The positive windows, one row for each place: of repeated ones that with the smallest id."""
    rows = windows.where("label = 1")
    rest = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), "id").alias("x"))
    return first.select(*key, "x.*").select(*rows.columns)
