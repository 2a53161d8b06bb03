"""Comparison of a query with its SQL on the same tables."""

import numbers
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "~"
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return str(bool(v))
    if isinstance(v, numbers.Number):
        f = float(v)
        return "~" if f != f else "0" if f == 0 else f"{f:.8g}"
    if isinstance(v, str):
        return v
    if hasattr(v, "__len__"):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(cell(v) for v in r) for r in df[cols].itertuples(index=False))
