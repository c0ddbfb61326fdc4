"""Comparison of a query with its SQL over the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def canon(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f":
        v = float(v)
        return None if math.isnan(v) else round(v, 5)
    if hasattr(v, "item"):
        return v.item()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([canon(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, con, query, sql, sf_dir):
    """None if the rows are the same, else what differs."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    columns = [x[0] for x in cur.description]
    theirs = rows_of(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if ours != theirs:
        k = next((i for i, (a, b) in enumerate(zip(ours, theirs)) if a != b), min(len(ours), len(theirs)))
        return f"{len(ours)} and {len(theirs)} rows; first different: {str(ours[k : k + 1])[:600]} and {str(theirs[k : k + 1])[:600]}"
    return None
