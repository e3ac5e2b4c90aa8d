"""Runs a registered query and its DuckDB SQL and compares names, types and rows."""

from __future__ import annotations

import datetime
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"create view {f.removesuffix('.parquet')} as "
                    f"select * from read_parquet('{sf_dir}/{f}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{type(v).__name__}:{v}"


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> str:
    """'' when equal, else what differs."""
    df = fn(spark, sf_dir)
    got = bag(df.columns, df.collect())
    if sql is None:
        return "" if sum(got.values()) else "no rows"
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    want = bag(cols, res.fetchall())
    if got != want:
        a, b = list((got - want).elements())[:2], list((want - got).elements())[:2]
        return (f"rows {sum(got.values())} vs {sum(want.values())}, differing {sum((got - want).values())};"
                f"\n   spark {a}\n   duck  {b}")
    kinds = {c[0]: str(c[1]) for c in res.description}
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t in ("int", "bigint") and {"int": "INTEGER", "bigint": "BIGINT"}[t] != kinds[f.name]:
            return f"type of {f.name}: {t} vs {kinds[f.name]}"
    return "" if got else "equal but empty"
