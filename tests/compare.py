"""Comparison of a query's rows with those of its SQL on the same Parquet tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    """A value that compares alike from either engine."""
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, bool | int | str) or value is None:
        return value
    if isinstance(value, list | tuple):
        return tuple(plain(x) for x in value)
    if hasattr(value, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in value.asDict().items()))
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql: str):
    done = con.execute(sql)
    return rows_of([c[0] for c in done.description], done.fetchall())


def difference(df, con, sql: str) -> str | None:
    """What differs, or None."""
    (have_columns, have), (want_columns, want) = spark_rows(df), sql_rows(con, sql)
    if have_columns != want_columns:
        return f"columns {have_columns} and {want_columns}"
    if len(have) != len(want):
        return f"{len(have)} and {len(want)} rows; " + str([r for r in have if r not in set(want)][:2]) + str([r for r in want if r not in set(have)][:2]) if all(not isinstance(x, dict) for r in have[:1] for x in r) else f"{len(have)} and {len(want)} rows"
    for a, b in zip(have, want):
        if a != b:
            return f"{dict(zip(have_columns, a))} and {dict(zip(have_columns, b))}"
    return None
