"""Comparison of a query with its DuckDB SQL on one scale folder."""

import os

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf_dir=SF_DIR):
    con = duckdb.connect()
    for table in os.listdir(sf_dir):
        path = f"{sf_dir}/{table}"
        con.execute(f"create view {table.removesuffix('.parquet')} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def same_rows(df, con, sql):
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in row) for row in df.select(columns).collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted(tuple(plain(row[i]) for i in at) for row in cursor.fetchall())
    assert got == expected
