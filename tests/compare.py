"""Spark rows against DuckDB rows, columns by name, without order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(files):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if hasattr(x, "isoformat"):
        return x.isoformat().split("+")[0]
    return x


def close(g, w) -> bool:
    """Equal, and numbers within 1e-9 of each other's size (or 1e-9)."""
    if isinstance(g, tuple) and isinstance(w, tuple):
        return len(g) == len(w) and all(map(close, g, w))
    if isinstance(g, float) and isinstance(w, float):
        return g == w or math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-9)
    return g == w


def sortable(row: tuple) -> str:
    """Rows in an order that the last digits of a number don't change."""
    short = lambda x: tuple(map(short, x)) if isinstance(x, tuple) else f"{x:.6g}" if isinstance(x, float) else x
    return repr(short(row))


def rows(names: list[str], data) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=sortable)


def same(df, con, sql: str) -> int:
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    want = rows(names, out.fetchall())
    got = rows(df.columns, df.collect())
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want, strict=True):
        assert close(g, w), (g, w)
    return len(got)
