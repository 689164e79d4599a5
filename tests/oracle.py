"""Runs a query and its DuckDB SQL over the same tables and compares the rows."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "~"
    if isinstance(v, str):
        return v
    if type(v).__name__.startswith("bool"):
        return str(bool(v))
    f = float(v)
    return repr(int(f)) if f == int(f) else repr(round(f, 6))


def rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(tuple(cell(v) for v in r) for r in pdf[columns].itertuples(index=False, name=None))


def same(df, con, sql):
    got, want = rows(df.toPandas()), rows(con.execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
