"""Spark-vs-DuckDB comparison used by the tests (the same contract as the driver's oracle check)."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.{digits}g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.{digits}g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(cols, rows, digits):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], digits) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark_df, sql: str, con, digits: int = 9):
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.sql(sql)
    d_cols = list(res.columns)
    d_rows = res.fetchall()
    info = {"spark_rows": len(s_rows), "sql_rows": len(d_rows)}
    if sorted(s_cols) != sorted(d_cols):
        info["cols"] = (sorted(s_cols), sorted(d_cols))
        return False, info
    a, b = rows_of(s_cols, s_rows, digits), rows_of(d_cols, d_rows, digits)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        info["first_diffs"] = diff
        info["cols_sorted"] = sorted(s_cols)
        return False, info
    return True, info
