import pytest

from vellumine.plans import registry

from .oracle import connect, same

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_duckdb(spark, data, con, name):
    same(registry.queries()[name](spark, data), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_runs(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0
