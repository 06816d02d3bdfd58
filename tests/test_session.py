import os

import pytest

import __spark_entry__ as entry
from vellumine import session


def _tables(spark):
    folder = session.shared_dir(spark).removeprefix("file:")
    return {x for x in os.listdir(folder) if x.startswith("t-")}


def test_stored_result_keeps_its_rows_and_nothing_else(spark):
    before = _tables(spark)

    @session.stored_result
    def query(n):
        first = session.materialise(spark.range(n))
        return session.materialise(first.selectExpr("id * 2 AS id")).where("id > 2")

    got = query(5)
    assert len(_tables(spark) - before) == 1
    assert sorted(r.id for r in got.collect()) == [4, 6, 8]


def test_tables_of_a_failed_query_are_removed(spark):
    before = _tables(spark)

    @session.stored_result
    def query():
        session.materialise(spark.range(3))
        raise ValueError("stop")

    with pytest.raises(ValueError, match="stop"):
        query()
    assert _tables(spark) == before


def test_entry_without_the_optional_package(monkeypatch):
    def gone(name):
        raise ModuleNotFoundError(name=name)

    monkeypatch.setattr(entry.importlib, "import_module", gone)
    assert "facet_all" in entry.queries() and not any(k.startswith(("p1_", "p9_")) for k in entry.queries())
    assert "p6_found" in entry.queries() and entry.oracle_sql()
