"""Compare a query with its SQL counterpart: columns by name, rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from catalog.fixtures import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}" if value else "0"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return f"{float(value):.6g}" if abs(value) < 1_000_000 else str(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([_plain(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(frame, con, sql: str, limit: int = 5) -> list[str]:
    left_cols, left = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    right_cols, right = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if left_cols != right_cols:
        return [f"columns {left_cols} != {right_cols}"]
    if len(left) != len(right):
        return [f"rows {len(left)} != {len(right)}"] + [f"{a} | {b}" for a, b in zip(left, right) if a != b][:limit]
    found = []
    for a, b in zip(left, right):
        if a != b:
            found.append(str([(c, x, y) for c, x, y in zip(left_cols, a, b) if x != y or c.endswith("id")]))
    return found[:limit]
