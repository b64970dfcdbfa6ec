"""Run a registered query and its SQL side by side and compare them as multisets of rows."""

from __future__ import annotations

import datetime
import math
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        value = float(value)
        return ("n", "nan" if math.isnan(value) else f"{value + 0.0:.10g}")
    if isinstance(value, datetime.datetime):
        return ("t", value.isoformat())
    return (type(value).__name__, str(value))


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, fn, sql) -> tuple[bool, str, float]:
    start = time.time()
    df = fn(spark, folder)
    mine = df.collect()
    took = time.time() - start
    if sql is None:
        return True, f"{len(mine)} rows, no SQL", took
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}", took
    a, b = rows_of(df.columns, mine), rows_of(names, theirs)
    if a != b:
        only_a, only_b = a - b, b - a
        detail = f"{sum(only_a.values())} and {sum(only_b.values())} rows differ of {len(mine)} and {len(theirs)}"
        return False, f"{detail}: {sorted(only_a, key=str)[:2]} against {sorted(only_b, key=str)[:2]}", took
    return True, f"{len(mine)} rows", took
