"""Every registered query, against its SQL where there is one."""

import pytest

import __spark_entry__ as contract
from delaylake.plans.checks import QUERIES
from oracle_check import connect, differences

SF = "/root/testdata/sf0.001"
ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = contract.queries()[name](spark, SF)
    if name in ROWS_ONLY:
        assert found.count() > 0
    else:
        assert differences(found, duck, contract.oracle_sql()[name]) == ""


def test_only_the_expected_queries_lack_sql():
    assert set(QUERIES) - set(contract.oracle_sql()) == ROWS_ONLY
    assert set(QUERIES) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
