"""Comparing a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(columns: list[str], data) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([row[k] for k in order]) for row in data)


def same(df, connection: duckdb.DuckDBPyConnection, sql: str) -> None:
    got = connection.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(names, got.fetchall())
