"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def compare(df, sql, folder):
    rel = duck(folder).sql(sql)
    cols = sorted(rel.columns)
    assert cols == sorted(df.columns)
    want = sorted([cell(r[c]) for c in cols] for r in (dict(zip(rel.columns, x)) for x in rel.fetchall()))
    got = sorted([cell(r[c]) for c in cols] for r in df.collect())
    assert len(want) == len(got), (len(want), len(got))
    bad = [(a, b) for a, b in zip(want, got) if a != b]
    assert not bad, (cols, bad[:3])
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    odd = {c: (t, kinds[c]) for c, t in df.dtypes if same.get(t, t) != kinds[c]}
    return len(got), odd
