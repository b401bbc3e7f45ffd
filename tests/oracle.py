"""Runs a query beside its DuckDB SQL and compares rows regardless of order."""

import math
from pathlib import Path

import duckdb
import pandas as pd


def rows_of(frame):
    cols = sorted(frame.columns)
    return cols, [tuple(r) for r in frame[cols].itertuples(index=False)]


def _key(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if hasattr(v, "tolist") and not hasattr(v, "dtype") or isinstance(v, list):
        return repr(list(v))
    if isinstance(v, str):
        return v
    try:
        return repr(float(f"{float(v):.10g}"))
    except (TypeError, ValueError):
        return str(v)


def same(spark, query, sql, sf):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    want_cols, want = rows_of(con.sql(sql).df())
    got_cols, got = rows_of(query(spark, str(sf)).toPandas())
    assert got_cols == want_cols
    a, b = sorted([tuple(map(_key, r)) for r in got]), sorted([tuple(map(_key, r)) for r in want])
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
    return len(a)
