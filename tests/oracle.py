"""Runs queries beside their SQL in DuckDB and compares whole results."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from pathlib import Path

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 9) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str:
    """An empty string if both results are equal."""
    found = con.execute(sql)
    want_names, want = rows_of([c[0] for c in found.description], found.fetchall())
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if names != want_names:
        return f"columns {names} and {want_names}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only Spark: {list((got - want).items())[:2]}; only SQL: {list((want - got).items())[:2]}"
    return ""
