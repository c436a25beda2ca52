"""Spark results against SQL over the same tables."""

import glob
import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 9)
    if hasattr(x, "tzinfo"):
        return str(x)
    return x


def same_rows(df, con, sql):
    """Both sides have the same columns and the same rows, as often."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = [tuple(_plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()]
    got = [tuple(_plain(r[c]) for c in sorted(names)) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
