"""Holds registered queries against their SQL."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def cell(x):
    if x is None or x != x:
        return ""
    if hasattr(x, "isoformat"):
        return str(x)[:26].removesuffix(" 00:00:00")
    if isinstance(x, float):
        return f"{x:.6g}" if x != int(x) or abs(x) > 1e15 else str(int(x))
    return str(x)


def rows(columns, found) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in found)


def differences(df, con, sql: str) -> str:
    """Empty if df has the columns and rows of sql; else what differs."""
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    want, have = rows(columns, cur.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    if want == have:
        return ""
    a, b = set(have) - set(want), set(want) - set(have)
    return f"{len(have)} rows against {len(want)}; only here {sorted(a)[:2]}, only there {sorted(b)[:2]}"
