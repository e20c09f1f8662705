"""Spark rows against DuckDB rows, without regard to order."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connection(sf_dir: str):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "null"
    return repr(round(float(v), 6) + 0.0) if isinstance(v, int | float | np.number) and not isinstance(v, bool | np.bool_) else str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted(tuple(_plain(v) for v in r) for r in frame[names].itertuples(index=False))


def same(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> None:
    assert sorted(spark_frame.columns) == sorted(sql_frame.columns)
    a, b = rows(spark_frame), rows(sql_frame)
    assert len(a) == len(b)
    assert a == b
