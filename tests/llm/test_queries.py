import pytest

from tests.oracle import connect, same
from vellumine.llm import queries, sql


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_duckdb(spark, data, name):
    same(queries.queries()[name](spark, data), connect(data), sql.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.oracle_sql())))
def test_query_runs_without_double_rows(spark, data, name):
    df = queries.queries()[name](spark, data)
    if name.endswith("_found"):
        rows = df.collect()
        assert rows and len(set(rows)) == len(rows)
    else:
        assert df.count() > 0
