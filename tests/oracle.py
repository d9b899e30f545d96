"""Comparison of a query with its SQL in DuckDB."""

import math
import os

import duckdb

DATA = os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return f"{float(v):.6f}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def connection(data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def differences(spark, name, query, sql, data=DATA, con=None):
    """None if both give the same rows under the same names, else what differs."""
    frame = query(spark, data)
    mine = rows_of(frame.columns, frame.collect())
    cursor = (con or connection(data)).execute(sql)
    columns = [c[0] for c in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"{name}: columns {sorted(frame.columns)} and {sorted(columns)}"
    if mine != theirs:
        a, b = [r for r in mine if r not in set(theirs)][:3], [r for r in theirs if r not in set(mine)][:3]
        return f"{name}: {len(mine)} and {len(theirs)} rows; {a} {b}"
    return None
