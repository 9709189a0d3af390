"""Runs a query in Spark and its SQL in DuckDB and compares rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from lattica.session import TABLES


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    c = con.execute(sql)
    given = [x[0] for x in c.description]
    names = sorted(given)
    return names, sorted((tuple(plain(r[given.index(k)]) for k in names) for r in c.fetchall()), key=str)
