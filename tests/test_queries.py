"""Every registered query of the core against its SQL on the smallest data."""

import pytest
from oracle import database, same

from lorespark import queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.collect()


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert same(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.collect() is not None
