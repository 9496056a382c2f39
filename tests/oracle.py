"""Rows of a query and of its SQL, in one comparable form."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(map(plain, x.values()))
    return x


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def of_spark(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def of_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        at = Path(f"{sf_dir}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{at}{'/*.parquet' if at.is_dir() else ''}'")
    cur = con.execute(sql)
    return normal([d[0] for d in cur.description], cur.fetchall())
