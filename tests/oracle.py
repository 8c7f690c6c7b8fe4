"""Comparison of a query with its SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(names), sorted(([clean(r[i]) for i in order] for r in data), key=str)


def differences(spark, name, f, sql, sf_dir) -> str:
    df = f(spark, sf_dir)
    c = connect(sf_dir)
    q = c.execute(sql)
    names = [x[0] for x in q.description]
    (a, x), (b, y) = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, q.fetchall())
    if a != b:
        return f"columns {a} and {b}"
    if x != y:
        other = [p for p in zip(x, y) if p[0] != p[1]][:2]
        return f"{len(x)} and {len(y)} rows, such as {other}"
    return ""
