"""Compares a registered query with its SQL on the smallest tables."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    return "NULL" if v is None or v != v else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


def same(spark, query, sql):
    df, other = query(spark, SF), connect().sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(other.columns)
    at = [other.columns.index(c) for c in cols]
    a = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    b = sorted(tuple(plain(r[i]) for i in at) for r in other.fetchall())
    assert a == b
