"""Runs a query and its SQL on the smallest data and compares the rows."""

import glob
import os

import pandas as pd

DATA = "/root/testdata/sf0.001"


def _cell(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else str(round(v, 6))
    if hasattr(v, "tolist"):
        return str(v.tolist())
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(str(tuple(_cell(v) for v in r)) for r in df.astype(object).itertuples(index=False))


def compare(spark, query, sql):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"create view {name} as select * from read_parquet('{f}')")
    got, want = query(spark, DATA).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
