"""Spark rows against DuckDB rows of the same tables."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if p.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    if isinstance(x, decimal.Decimal):
        return int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(columns: list[str], found) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in found)


def compare(df, sql: str, con) -> tuple[Counter, Counter, list[str], list[str]]:
    r = con.sql(sql)
    mine = rows(df.columns, df.collect())
    theirs = rows(r.columns, r.fetchall())
    return mine - theirs, theirs - mine, sorted(df.columns), sorted(r.columns)
