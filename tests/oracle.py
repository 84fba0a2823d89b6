"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """A value that both engines show alike; doubles to nine digits."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.9g}"
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return str(x)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, query, sql: str, folder: str) -> str:
    """What differs first, or nothing."""
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = query(spark, folder)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)}, expected {sorted(names)}"
    ours, theirs = rows_of(got.columns, got.collect()), rows_of(names, found.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows, expected {len(theirs)}"
    return next((f"{a}, expected {b}" for a, b in zip(ours, theirs, strict=True) if a != b), "")
