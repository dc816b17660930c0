"""Comparison of a query with its SQL on DuckDB."""

import decimal
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "tzinfo") and v.tzinfo:
        return v.replace(tzinfo=None)
    return v


def connect():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        path = os.path.join(DATA, f)
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def same(df, sql, c):
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=str)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=str)
    assert got == want
