"""Compares a query's rows with those of its SQL in DuckDB over the same tables."""

from __future__ import annotations

import datetime
import decimal
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """'' if the rows are the same, else what differs."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want = rows(names, got.fetchall())
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    if have == want:
        return ""
    return f"{sum(have.values())} and {sum(want.values())} rows; only Spark: {list((have - want))[:2]}; only SQL: {list((want - have))[:2]}"
