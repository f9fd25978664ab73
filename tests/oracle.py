"""Comparison of a DataFrame with SQL that DuckDB runs on the same files."""

import glob
import os
from collections import Counter

import duckdb


def _value(x):
    if isinstance(x, bool) or x is None:
        return x
    return float(x) if isinstance(x, (int, float)) else str(x)


def same(df, sql: str, sf: str) -> None:
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    columns = sorted(df.columns)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    got = Counter(tuple(_value(r[c]) for c in columns) for r in df.collect())
    assert got == Counter(tuple(_value(r[names.index(c)]) for c in columns) for r in want.fetchall())
