"""Order-insensitive comparison of two result sets (columns sorted by name,
values normalised: floats rounded, dates as ISO text)."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import json
import math
import os

RAW_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def canonical(cols: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(json.dumps([norm(r[i]) for i in order], default=str) for r in rows)


def digest(cols: list[str], rows: list[tuple]) -> str:
    return hashlib.sha256("\n".join(canonical(cols, rows)).encode()).hexdigest()[:16]


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in RAW_TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def run_oracle(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()
