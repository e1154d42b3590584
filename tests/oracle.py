"""Holds a query's rows against its SQL in DuckDB."""

import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def connect(folder=FOLDER):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in df[columns].itertuples(index=False))


def same(spark, con, query, sql, folder=FOLDER):
    got, want = rows(query(spark, folder).toPandas()), rows(con.execute(sql).df())
    assert got == want
    assert want[1]
