"""Every registered query against its SQL, on the small tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

# whole documents take minutes of small rounds; test_substrings covers the plan
SLOW = {"longest_shared_substring_long"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, sf, con, name):
    assert compare(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - SLOW))
def test_runs_without_sql(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    found = entry.entry(spark)
    assert found.columns == ["dependent", "referenced", "line"]
    assert found.count() > 0
