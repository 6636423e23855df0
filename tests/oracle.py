"""Runs queries beside their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name: str, run, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows, else what differs."""
    df = run(spark, sf_dir)
    left = rows_of(df.columns, df.collect())
    found = connect(sf_dir).sql(sql)
    right = rows_of(found.columns, found.fetchall())
    if sorted(df.columns) != sorted(found.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(found.columns)}"
    if left != right:
        only = [x for x in left if x not in set(right)][:3], [x for x in right if x not in set(left)][:3]
        return f"{name}: {len(left)} and {len(right)} rows, {only}"
    return ""
