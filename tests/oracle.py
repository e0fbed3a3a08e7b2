"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os
from glob import glob

import duckdb


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v if isinstance(v, (str, bool, int)) else str(v)


def rows(names, table):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in table), key=repr)


def connect(d):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def same(spark, d, query, sql):
    df = query(spark, d)
    out = connect(d).execute(sql)
    names = [x[0] for x in out.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, out.fetchall())
