"""Comparison of a query's rows with those of its oracle SQL on DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return repr(v)


def same_rows(con, sql, df):
    rel = con.sql(sql)
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    want = sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    got = sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
    assert got == want
