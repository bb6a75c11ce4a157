"""Rows of a DuckDB query over small tables given as Python rows, sorted, columns by name."""

import duckdb
import pyarrow as pa


def duck_rows(sql, **tables):
    c = duckdb.connect()
    for name, (columns, rows) in tables.items():
        c.register(name, pa.table({k: [r[j] for r in rows] for j, k in enumerate(columns)}))
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[k] for k in order) for r in got.fetchall()), key=lambda r: [(x is not None, x) for x in r])  # nulls first
