"""Spark-vs-DuckDB comparison in the driver's manner: column names sorted,
rows compared as an order-insensitive multiset of values."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)     # exact bits, sign of zero included
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(_norm(r[i]) for i in order) for r in rows], [cols[i] for i in order]


def compare(spark_df, con, sql):
    s_cols = spark_df.columns
    s_rows, s_names = rows_of(s_cols, [tuple(r) for r in spark_df.collect()])
    res = con.execute(sql)
    d_cols = [x[0] for x in res.description]
    d_rows, d_names = rows_of(d_cols, res.fetchall())
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    return {
        "names": s_names == d_names, "s_names": s_names, "d_names": d_names,
        "rows": (len(s_rows), len(d_rows)),
        "values": sorted(s_rows, key=key) == sorted(d_rows, key=key),
        "s_sample": sorted(s_rows, key=key)[:3], "d_sample": sorted(d_rows, key=key)[:3],
        "s_rows": s_rows, "d_rows": d_rows,
    }
