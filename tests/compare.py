"""Runs a query and its SQL over the same tables and compares the rows, whatever their order."""

from __future__ import annotations

import datetime
import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    db = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        db.execute(f"create view {t} as select * from '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
    return db


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, Decimal):
        return repr(round(float(v), 6) + 0.0) if v % 1 else str(int(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return "null" if v is None else str(v)


def differences(spark, make, sql: str, sf_dir: str, db=None) -> str:
    """Empty if all is well."""
    df = make(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    cur = (db or database(sf_dir)).execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != names:
        return f"columns {names}, in SQL {sorted(columns)}"
    at = [columns.index(c) for c in names]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    if got != want:
        a, b = set(got), set(want)
        return f"{len(got)} rows, in SQL {len(want)}; only here {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
    return ""
