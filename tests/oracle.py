"""Comparison of a query with its SQL twin in DuckDB, without regard to order."""

import datetime
import decimal
import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return bytes(v) if isinstance(v, bytearray) else v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)


def sql_rows(sql, sf=SF):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    r = c.sql(sql)
    at = sorted(range(len(r.columns)), key=lambda i: r.columns[i])
    return sorted(r.columns), sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str)
