"""Spark rows against DuckDB rows, in any order."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) and df[c].dtype != bool:
            df[c] = df[c].astype(float).round(6) + 0.0
        else:
            df[c] = [None if v is None or isinstance(v, float) and np.isnan(v) else str(v) for v in df[c]]
            df[c] = df[c].astype(object).where(df[c].notna(), "(null)")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = normal(got), normal(want)
    assert len(a) == len(b)
    for c in a.columns:
        x, y = a[c], b[c]
        if x.isna().all() or y.isna().all() or x.dtype != y.dtype:  # a column of nulls has whatever type
            x, y = x.replace("(null)", np.nan).astype(float), y.replace("(null)", np.nan).astype(float)
        assert ((x == y) | (x.isna() & y.isna())).all(), c
