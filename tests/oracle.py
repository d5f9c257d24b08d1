"""Runs a query in Spark and its SQL in DuckDB and compares all rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connection(sf_dir=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, query, sql, sf_dir=SF):
    df = query(spark, sf_dir)
    rel = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    ours = sorted(repr([r[c] for c in names]) for r in (x.asDict() for x in df.collect()))
    theirs = sorted(repr([dict(zip(rel.columns, r, strict=True))[c] for c in names]) for r in rel.fetchall())
    assert ours == theirs
