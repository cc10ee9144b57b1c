import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks import all_oracles, all_queries
from checks.inputs import TABLES
from compare import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_queries()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["c_custkey", "c_name", "c_nationkey"]


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, connection, name):
    verdict = compare(spark, connection, name, all_queries()[name], all_oracles()[name], SF_DIR)
    assert verdict.startswith("ok"), verdict
