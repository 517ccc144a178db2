"""Spark results against DuckDB, order-insensitive, doubles to six digits."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(folder: str):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr([_cell(v) for v in r]) for r in df.itertuples(index=False, name=None))


def same(spark_df, sql: str, con) -> None:
    a, b = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    x, y = rows(a), rows(b)
    assert len(x) == len(y)
    assert x == y, next((p, q) for p, q in zip(x, y) if p != q)
