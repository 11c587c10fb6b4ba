"""Comparing a query with its SQL in DuckDB, value by value."""

from __future__ import annotations

import datetime
import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (pd.Timestamp, datetime.date)):
        return str(pd.Timestamp(v))
    if isinstance(v, (int, float)) and not isinstance(v, bool) and float(v) == int(v):
        return str(int(v))
    return str(v)


def rows(df: pd.DataFrame) -> list:
    return sorted([cell(v) for v in r] for r in df[sorted(df.columns)].astype(object).values.tolist())


def assert_same(df, sql: str, con) -> None:
    got, want = df.toPandas(), con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    types = dict(df.dtypes)
    seen = {c[0]: str(c[1]) for c in con.execute(sql).description}
    assert {c: TYPES[t] for c, t in types.items()} == seen
    assert rows(got) == rows(want)
