"""Every registered query runs on the smallest tables, and those with SQL give the rows that DuckDB gives."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from selvage.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    base = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        base.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return base


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)[:19]
    if isinstance(v, (bool, str)):
        return v
    return float(v) if not isinstance(v, (list, tuple, dict)) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tables, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in registry.ORACLES:
        return
    found = tables.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(row[i]) for i in order) for row in found.fetchall()), key=repr)
