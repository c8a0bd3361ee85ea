"""Compare a query's rows with those of its DuckDB twin."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def normal(d: pd.DataFrame) -> pd.DataFrame:
    cols = sorted(d.columns)

    def one(v):
        if v is None or (isinstance(v, float) and v != v):
            return "-"
        return str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return d[cols].map(one).sort_values(cols).reset_index(drop=True)


def same(spark_rows: pd.DataFrame, twin_rows: pd.DataFrame) -> None:
    a, b = normal(spark_rows), normal(twin_rows)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    pd.testing.assert_frame_equal(a, b)
