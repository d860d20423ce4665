"""Every registered query against its SQL on the generated tables."""

import pytest

import __spark_entry__ as contract
from workload import ORACLES, QUERIES
from workload.check import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    ok, message, _ = compare(spark, con, sf_dir, name)
    assert ok, message


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    result = contract.entry(spark)
    assert {"customer_id", "product_id", "product_name", "risk_rating", "expense_ratio", "rank"} <= set(result.columns)
    assert result.count() > 0
