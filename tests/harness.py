"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb

DATA = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, Decimal):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def ordered(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def compare(spark, query, sql: str, sf_dir: str = DATA) -> int:
    """Asserts equal columns and rows; gives the number of rows."""
    df = query(spark, sf_dir)
    names, rows = ordered(df.columns, [tuple(r) for r in df.collect()])
    result = duck(sf_dir).execute(sql)
    want_names, want = ordered([d[0] for d in result.description], result.fetchall())
    assert names == want_names
    assert len(rows) == len(want), (len(rows), len(want), rows[:3], want[:3])
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    assert not bad, (len(bad), bad[:3])
    return len(rows)
