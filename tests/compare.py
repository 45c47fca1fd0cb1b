"""Runs a query on Spark and its SQL on DuckDB and compares rows, names and values."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        v = float(v)
        return "NaN" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, int):
        return repr(v + 0.0) if abs(v) < 2**53 else str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def same(df, con, sql: str) -> None:
    have = df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = [df.columns.index(n) for n in sorted(df.columns)]
    other = [names.index(n) for n in sorted(names)]
    a = sorted("|".join(plain(r[i]) for i in order) for r in have)
    b = sorted("|".join(plain(r[i]) for i in other) for r in want)
    assert a == b
