"""Holds a query against its SQL in DuckDB."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v if isinstance(v, int | bool | datetime.datetime) else str(v)


def by_text(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return con


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    got = by_text([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = by_text([tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()])
    assert len(got) == len(want)
    assert got == want
