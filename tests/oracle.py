"""Comparison of a query with its SQL in DuckDB over the same Parquet files."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connection(sf: str):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def shown(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


def assert_same(df, sql: str, sf: str = SF) -> None:
    result = connection(sf).sql(sql)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns), f"columns repeat: {columns}"
    assert columns == sorted(result.columns)
    at = [result.columns.index(c) for c in columns]
    want = sorted(tuple(shown(row[i]) for i in at) for row in result.fetchall())
    got = sorted(tuple(shown(row[c]) for c in columns) for row in df.collect())
    assert got == want
