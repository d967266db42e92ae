"""Comparison of a query's rows with those of its oracle SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

from lakeloom.sources.tables import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return db


def _value(x):
    if x is None:
        return "null"
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}" if x else "0"
    if isinstance(x, bool) or not isinstance(x, int):
        return str(x)
    return f"{x}"


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(df, db, text: str) -> str | None:
    """None if both agree, else what differs."""
    found = db.execute(text)
    names = [d[0] for d in found.description]
    kinds = [str(d[1]) for d in found.description]
    theirs = found.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    if any("HUGEINT" in k for k in kinds):
        return f"types {kinds}"
    ours = rows_of(df.columns, df.collect())
    theirs = rows_of(names, theirs)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b and not all(x == y or _near(x, y) for x, y in zip(a, b)):
            return f"{a} and {b}"
    return None


def _near(x: str, y: str) -> bool:
    try:
        return math.isclose(float(x), float(y), rel_tol=1e-6)
    except ValueError:
        return False
