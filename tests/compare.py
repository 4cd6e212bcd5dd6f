"""Spark rows against DuckDB rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same_rows(spark, data, run, sql):
    df = run(spark, data)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    rel = con.sql(sql)
    columns = list(rel.columns)
    assert sorted(columns) == names
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in rel.fetchall()), key=repr)
    assert ours == theirs
