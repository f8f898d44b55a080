import pytest

import __spark_entry__ as entry
from conftest import SMALL
from oracle import assert_same
from tideline.plans.catalogue import ORACLE_SQL, QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, name):
    assert_same(entry.queries()[name](spark, SMALL), ORACLE_SQL[name], SMALL)


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["key", "value"] and found.count() > 0
