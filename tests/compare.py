"""Spark's rows against DuckDB's, as multisets with doubles rounded."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def cell(x):
    return round(x, 6) if isinstance(x, float) else float(x) if type(x).__name__ == "Decimal" else x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(cell(r[i]) for i in order) for r in found)


def differences(df, con, sql):
    """None, or what differs."""
    a, got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    b, want = rows([d[0] for d in cur.description], cur.fetchall())
    if a != b:
        return f"columns {a} and {b}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only Spark: {list((got - want).items())[:3]}; only SQL: {list((want - got).items())[:3]}"
    return None
