"""Every registered query against its DuckDB twin on the smallest driver tables."""

import datetime as dt
import decimal
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver
from siltstone.operators import joins
from siltstone.plans import access_oracle, access_queries, lake_oracle, lake_queries
from siltstone.plans.lake_queries import TABLES

QUERIES = {**lake_queries.QUERIES, **access_queries.QUERIES}
ORACLE = {**lake_oracle.ORACLE, **access_oracle.ORACLE}

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    return value


def compare(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    ours = Counter(tuple(plain(row[c]) for c in columns) for row in frame.collect())
    found = duck.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_twin(spark, duck, name):
    compare(spark, duck, name)


@pytest.mark.parametrize("name", ["object_capabilities", "decisions", "visible_columns", "grant_revoke"])
def test_query_matches_its_twin_without_broadcast(spark, duck, name, monkeypatch):
    monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        compare(spark, duck, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(driver.queries())
    assert set(ORACLE) <= set(driver.oracle_sql())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
