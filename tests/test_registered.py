"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as contract


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_matches_sql(spark, con, sf_dir, name):
    ok, message = compare(spark, con, name, sf_dir)
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_runs_without_sql(spark, sf_dir, name):
    assert contract.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
