"""Spark results against DuckDB's on the same tables."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, str) else str(v)


def assert_same(query, sql, spark, sf_dir, con):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)
    assert got == want
