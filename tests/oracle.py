"""Runs a query and its SQL twin on the same files and compares whole results."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat() + "T00:00:00"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, con, fn, sql, sf_dir) -> tuple[str, int]:
    """('' or the first difference, number of rows)."""
    df = fn(spark, sf_dir)
    got_names, got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    want_names, want = rows([c[0] for c in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", len(got)
    if len(got) != len(want):
        extra = [r for r in got if r not in set(map(tuple, want))][:2] if len(got) < 5000 else []
        return f"rows {len(got)} != {len(want)} e.g. {extra} | {got[:1]} | {want[:1]}", len(got)
    for a, b in zip(got, want):
        if repr(a) != repr(b):
            return f"{got_names}: {a} != {b}", len(got)
    return "", len(got)
