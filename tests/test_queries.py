"""Every registered query with SQL gives the same rows in DuckDB, on the smallest tables."""

import datetime
import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    ran = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in ran.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
