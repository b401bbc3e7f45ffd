"""How much of a joined table got a score, counted while the table is written, and a refusal where too little did."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Largest share of rows without a score that is accepted.
MOST_MISSING = 0.01


class CoverageError(ValueError):
    """Too many rows lack a score."""


class Coverage:
    """Counts that come with the job that reads ``table``: rows, rows whose ``score`` is null or NaN, and one count for each
    condition in ``dropped``. They are there after an action on ``table``, without a second scan."""

    def __init__(self, df: DataFrame, score: str, dropped: Mapping[str, Column] | None = None):
        missing = F.col(score).isNull()
        if dict(df.dtypes)[score] in ("float", "double"):
            missing = missing | F.isnan(score)
        self._seen, self._names = Observation(), list(dropped or {})
        each = [F.sum(F.coalesce(c.cast("boolean").cast("long"), F.lit(0))).alias(f"dropped_{n}") for n, c in (dropped or {}).items()]
        self.table = df.observe(self._seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(missing.cast("long")), F.lit(0)).alias("missing"), *each)

    def counts(self) -> dict[str, float]:
        """n, missing, frac_missing and the counts of dropped rows. Waits for an action on ``table``."""
        got = self._seen.get
        return {"n": got["n"], "missing": got["missing"], "frac_missing": got["missing"] / got["n"] if got["n"] else 0.0} | {f"dropped_{n}": got[f"dropped_{n}"] or 0 for n in self._names}

    def check(self, most: float = MOST_MISSING) -> dict[str, float]:
        """The counts; fails where more than ``most`` of the rows lack a score."""
        found = self.counts()
        if found["frac_missing"] > most:
            raise CoverageError(f"{found['missing']} of {found['n']} rows have no score ({found['frac_missing']:.2%}), more than {most:.2%}")
        return found


def written(df: DataFrame, score: str, path: str, most: float = MOST_MISSING, dropped: Mapping[str, Column] | None = None) -> DataFrame:
    """``df`` written to ``path`` and read back; fails after the writing job where too many rows lack a score."""
    seen = Coverage(df, score, dropped)
    seen.table.write.parquet(path)
    seen.check(most)
    return df.sparkSession.read.schema(df.schema).parquet(path)
