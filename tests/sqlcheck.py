"""Queries held against their SQL on the smallest test tables."""

import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in os.listdir(DATA):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    return c


def equal(spark, connection, query, sql):
    df = query(spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    cursor = connection.execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(repr([r[names.index(c)] for c in columns]) for r in cursor.fetchall())
