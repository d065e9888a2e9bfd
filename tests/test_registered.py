"""Every registered query against its SQL twin, over whole tables."""

import __spark_entry__ as entry
import pytest
from compare import check, connect

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    result = check(spark, con, SF, name, QUERIES[name], ORACLE.get(name))
    assert result["ok"], result["why"]


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
