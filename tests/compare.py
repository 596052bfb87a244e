"""Rows of a Spark query against DuckDB's for the SQL that goes with it."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return str(x)
    if isinstance(x, float) and math.isfinite(x):
        return f"{x:.6g}" if x != int(x) else str(int(x))
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    try:
        return f"{float(x):.6g}" if float(x) != int(x) else str(int(x))
    except (TypeError, ValueError):
        return str(x)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if the rows are the same."""
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    want, got = rows_of(names, res.fetchall()), rows_of(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if want != got:
        a, b = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
        return f"{len(got)} rows and {len(want)}; only Spark: {a}; only SQL: {b}"
    return None
