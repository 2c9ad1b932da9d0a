"""Spark-vs-DuckDB comparison used by the oracle script and the test-suite.

Order-insensitive: column names sorted, rows sorted; NULL/NaN/NaT are one
value; dates/timestamps compared as ISO text; numbers as floats to
``digits`` significant digits.
"""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v, digits=12):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.{digits}g}")
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return norm(v.item(), digits)
        except Exception:  # noqa: BLE001
            pass
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day).isoformat(sep=" ")
    if hasattr(v, "asDict"):
        return norm(v.asDict(recursive=True), digits)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x, digits)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, digits) for x in v)
    return v


def canon(cols, rows, digits=12):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i], digits) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str, digits: int = 12) -> str | None:
    """None when equal, else a short reason."""
    srows, scols = [tuple(r) for r in df.collect()], df.columns
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    if sorted(scols) != sorted(ocols):
        return f"columns differ: spark={sorted(scols)} oracle={sorted(ocols)}"
    if len(srows) != len(orows):
        return f"row count differs: spark={len(srows)} oracle={len(orows)}"
    a, b = canon(scols, srows, digits), canon(ocols, orows, digits)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"values differ, e.g. {diff}"
    return None
