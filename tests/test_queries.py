"""Every registered query against its SQL twin on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry_module
from tallybook.plans.oracle import ORACLES
from tallybook.plans.workload import QUERIES
from tools.check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
NO_TWIN = {
    "reduced_ols_inference",
    "sweep_wide",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_twins_are_complete():
    assert set(QUERIES) - set(ORACLES) == NO_TWIN
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, FOLDER).startswith(("ok", "no twin"))
