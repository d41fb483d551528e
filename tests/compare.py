"""Spark rows against DuckDB's, as multisets."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 3) + 0.0
    return int(x) if isinstance(x, bool) else str(x) if hasattr(x, "isoformat") else float(x) if type(x).__name__ == "Decimal" else x


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], Counter(tuple(norm(r[i]) for i in at) for r in rows)


def differs(df, c, sql):
    """None, or what differs."""
    q = c.sql(sql)
    a, x = rows_of(df.columns, [tuple(r) for r in df.collect()])
    b, y = rows_of(q.columns, q.fetchall())
    if a != b:
        return f"columns {a} and {b}"
    if x != y:
        return f"{sum(x.values())} and {sum(y.values())} rows; only Spark: {list((x - y).items())[:3]}; only SQL: {list((y - x).items())[:3]}"
    return None
