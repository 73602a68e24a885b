"""Run registered queries next to their DuckDB text and compare every value."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        if hasattr(v, "as_integer_ratio") and not isinstance(v, int):
            return float(v)
    except (OverflowError, ValueError):
        pass
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def check(spark, sf_dir: str, query, sql: str | None) -> tuple[str, int, float]:
    """("ok" | "rows-only" | what differs, row count, seconds)."""
    start = time.time()
    df = query(spark, sf_dir)
    names = df.columns
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return "rows-only", len(got), took
    cur = duck(sf_dir).execute(sql)
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(set(names) ^ set(want_names))}", len(got), took
    a, b = _rows(names, got), _rows(want_names, want)
    if len(a) != len(b):
        extra = list(set(map(repr, a)) - set(map(repr, b)))[:2]
        return f"rows {len(a)} vs {len(b)}: only spark {extra}", len(got), took
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        cols = sorted(names)
        x, y = bad[0]
        diff = [(c, p, q) for c, p, q in zip(cols, x, y) if p != q]
        return f"{len(bad)} rows differ, first: {diff[:3]}", len(got), took
    return "ok", len(got), took
