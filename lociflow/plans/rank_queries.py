"""Rank statistics on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators import rankstats
from lociflow.sources.tables import table


def auroc(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    scored = rankstats.auroc(docs.join(labels, "doc_id"), "n_chars", "quality", ["lang"])
    return scored.withColumn("auroc", F.round("auroc", 9))


QUERIES = {"auroc": auroc}

ORACLES = {
    "auroc": """
        WITH r AS (
            SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS mid
            FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL)
        SELECT lang, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS n_pos, sum(CASE WHEN quality <> 1 THEN 1 ELSE 0 END)::BIGINT AS n_neg,
            round((sum(CASE WHEN quality = 1 THEN mid ELSE 0 END) - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos * n_neg, 0), 9) AS auroc
        FROM r GROUP BY lang""",
}
