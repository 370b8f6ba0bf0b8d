"""Comparison of a query with its SQL in DuckDB: same columns, same rows in any order."""

from __future__ import annotations

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """A connection with the test tables as views."""
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    """A value that compares across engines."""
    if isinstance(v, decimal.Decimal | float):
        return round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def same(df, relation) -> bool:
    """Whether both hold the same rows under the same names."""
    names = sorted(df.columns)
    if sorted(relation.columns) != names:
        return False
    left = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    at = [relation.columns.index(n) for n in names]
    return left == sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
