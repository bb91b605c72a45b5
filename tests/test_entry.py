"""The driver contract; every catalogue query that has SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from hduframe.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return float(value) if isinstance(value, Decimal) else value


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    frame = catalogue.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = ordered(frame.select(*columns).collect())
    if name in catalogue.ORACLE_SQL:
        want = con.sql(catalogue.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert got == ordered([r[k] for k in at] for r in want.fetchall())
    else:
        assert got


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
