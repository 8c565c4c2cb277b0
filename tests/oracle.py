"""Run a registered query and its SQL twin and compare them as multisets of rows."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, Counter(tuple(_value(v) for v in r) for r in df.select(*columns).collect())


def oracle_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_value(r[i]) for i in order) for r in cur.fetchall())


def differences(df, con, sql) -> str | None:
    sc, sr = spark_rows(df)
    oc, orows = oracle_rows(con, sql)
    if sc != oc:
        return f"columns differ: {sc} / {oc}"
    if sr != orows:
        a, b = sr - orows, orows - sr
        cut = lambda c: [str(r)[:400] for r in list(c)[:2]]
        return f"rows {sum(sr.values())} / {sum(orows.values())}; only spark {cut(a)}; only sql {cut(b)}"
    return None
