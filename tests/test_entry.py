"""The driver contract: every query has a stable shape, and most are checked against their SQL."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "lineitem", "supplier", "nation")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def cell(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return ""
    if hasattr(value, "year"):
        return str(pd.Timestamp(value))
    return repr(float(value) + 0.0) if isinstance(value, (int, float)) else str(value)


def rows(frame):
    ordered = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in ordered.values.tolist())


def test_entry(spark):
    assert contract.entry(spark).count() == 377


def test_every_query_has_its_sql():
    # Text queries, which are a part that can be left out, are checked in their own tests.
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_its_sql(spark, database, name):
    ours = QUERIES[name](spark, SF).toPandas()
    theirs = database.execute(ORACLE[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
