"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__
from loomgraph.plans.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for f in os.listdir(SMALL):
        found.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return found


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SMALL)
    if name not in ORACLES:
        assert got.count() > 0
        return
    want = db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    expected = sorted(repr([plain(v) for v in r]) for r in want.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == expected


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
