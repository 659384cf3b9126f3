"""Runs a query and its SQL on the same tables and compares rows without order."""

import math
import os
from datetime import date, datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(df, sql: str, sf_dir: str) -> None:
    names = sorted(df.columns)
    ours = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    found = database(sf_dir).execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    assert ours == theirs
