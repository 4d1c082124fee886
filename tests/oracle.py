"""Compares a query's rows with those that DuckDB gives for its SQL on the same tables."""

import math
import os
from collections import Counter
from glob import glob

import duckdb

SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(_plain, v))
    return bytes(v) if isinstance(v, bytearray) else v


def difference(df, sql):
    """Up to three rows that only df has, and three that only the SQL has; both have the same columns."""
    con = duckdb.connect()
    for path in glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    theirs = Counter(map(_plain, cur.fetchall()))
    ours = Counter(_plain(tuple(r)) for r in df.select(*(f"`{n}`" for n in names)).collect())
    return list(ours - theirs)[:3], list(theirs - ours)[:3]
