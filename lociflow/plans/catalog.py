"""Every registered query of the library with its SQL: ``QUERIES`` and ``ORACLES`` hold the union of the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lociflow.plans import interval_queries, model_queries, panel_queries, rank_queries, sequence_queries, stat_queries

MODULES = (interval_queries, model_queries, panel_queries, rank_queries, sequence_queries, stat_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}
