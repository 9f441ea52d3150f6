"""Comparison of a query with its SQL in DuckDB, rows as multisets."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if v is not None and not isinstance(v, (str, int, bool, bytes)):
        return round(float(v), 6) if hasattr(v, "__float__") else str(v)
    return v


def multiset(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark_df, db, sql: str) -> str:
    """Empty if equal, else what differs."""
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    want, got = multiset(names, found.fetchall()), multiset(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(n.lower() for n in names) != sorted(c.lower() for c in spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    if want != got:
        return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}, only there {list((want - got).items())[:3]}"
    return "" if want else "no rows"
