"""A Spark query's rows against those of DuckDB."""

import os

import duckdb


def views(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{t}'")
    return con


def canon(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def same(df, relation):
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    one = sorted(repr([canon(r[c]) for c in names]) for r in df.collect())
    at = [relation.columns.index(c) for c in names]
    two = sorted(repr([canon(r[i]) for i in at]) for r in relation.fetchall())
    assert one == two
