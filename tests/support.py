"""Comparison of query results with DuckDB's."""

from __future__ import annotations

import glob
import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(normal, value))
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)


def assert_same(df, con, sql: str) -> int:
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    want = bag([d[0] for d in found.description], found.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(*(x[1] for x in (got, want))):
        assert a == b
    return len(got[1])
