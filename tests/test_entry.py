"""The driver contract: every query equals its SQL on another engine."""

import glob
import os
import sys

import duckdb
import pytest

from conftest import SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as contract  # noqa: E402
from cellwatch.plans import catalog, oracle  # noqa: E402
from check_oracle import differences  # noqa: E402


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracle.statements())
    assert set(catalog.QUERIES) <= set(contract.queries()) and set(oracle.statements()) <= set(contract.oracle_sql())


def test_flagship(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    got = contract.queries()[name](spark, SMALL).toPandas()
    assert not differences(got, sql.execute(contract.oracle_sql()[name]).df())
