"""Compare a Spark result with DuckDB's on the same tables, as unordered rows."""

import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def rows(df):
    def one(x):
        if hasattr(x, "item"):
            x = x.item()
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return float(f"{x + 0.0:.9g}") if isinstance(x, float) else x

    df = df[sorted(df.columns)]
    return sorted((tuple(one(v) for v in r) for r in df.astype(object).where(df.notna(), None).values.tolist()), key=str)


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
