"""Every registered query equals its SQL counterpart on the smallest tables."""

import pytest

import __spark_entry__ as contract
from sourcetally.catalog.queries import REGISTRY
from check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return connect(SF)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(REGISTRY) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    same, *_, difference = compare(spark, con, SF, name)
    assert same, difference
