"""Run a query in Spark and its SQL in DuckDB over the same files, and compare values exactly."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{source}'")
    return con


def _plain(x):  # noqa: ANN001, ANN202
    if x is None:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return None if math.isnan(x) else x
    return x


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in t))


def difference(df, con: duckdb.DuckDBPyConnection, sql: str, digits: int | None = None) -> str | None:  # noqa: ANN001
    """None if equal, else what differs."""
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    found = con.execute(sql)
    want_cols = [c[0] for c in found.description]
    want = found.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} and {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} and {len(want)}"
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    kinds = lambda rows: [sorted({type(v).__name__ for v in c if v is not None}) for c in zip(*rows)]
    if a and kinds(a) != kinds(b):
        return f"types {sorted(got_cols)} {kinds(a)} and {kinds(b)}"
    if digits is not None:
        cut = lambda t: tuple(float(f"%.{digits}g" % v) if isinstance(v, float) else v for v in t)
        a, b = [cut(t) for t in a], [cut(t) for t in b]
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, {sorted(got_cols)}: {bad[0]}" if bad else None
