"""Queries of problem 6 over layouts and raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumine.operators import nested
from vellumine.session import stored_result
from vellumine.sources.tables import table


def _layouts(spark: SparkSession, d: str) -> DataFrame:
    return nested.identified(table(spark, d, "layouts").select("record_id", "paper_sha", "pages"), "layouts")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return nested.identified(nested.typed_records(table(spark, d, "raw_records")), "raw_records")


def p6_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return nested.occurrences(_layouts(spark, d)).unionByName(nested.occurrences(_raw(spark, d)))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    tables = nested.stored(_layouts(spark, d).unionByName(_raw(spark, d)))
    return nested.found(nested.rebuilt(tables["roots"], tables["bridge"]))


def p6_layouts(spark: SparkSession, d: str) -> DataFrame:
    return nested.found(nested.occurrences(_layouts(spark, d)))


def p6_bridge(spark: SparkSession, d: str) -> DataFrame:
    return nested.bridge(p6_occurrences(spark, d))


def p6_tokens(spark: SparkSession, d: str) -> DataFrame:
    return nested.tokens_table(_layouts(spark, d).unionByName(_raw(spark, d)))


def p6_bundles(spark: SparkSession, d: str) -> DataFrame:
    return nested.bundles_table(_layouts(spark, d).unionByName(_raw(spark, d)))


def p6_pages(spark: SparkSession, d: str) -> DataFrame:
    return nested.pages_table(_layouts(spark, d).unionByName(_raw(spark, d)))


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    layouts, raw = table(spark, d, "layouts"), nested.typed_records(table(spark, d, "raw_records"))
    return nested.records_table(layouts, "layouts").unionByName(nested.records_table(raw, "raw_records"))


def p6_layout_records(spark: SparkSession, d: str) -> DataFrame:
    return nested.records_table(table(spark, d, "layouts"), "layouts")


QUERIES = {f.__name__: f for f in (p6_occurrences, p6_layouts, p6_bridge, p6_tokens, p6_bundles, p6_pages, p6_records, p6_layout_records)}
QUERIES["p6_found"] = stored_result(p6_found)

SQL = {
    "p6_layouts": """
WITH p AS (SELECT record_id, unnest(range(len(pages))) AS i, unnest(pages) AS page FROM layouts),
b AS (SELECT record_id, i, unnest(range(len(page.layout.bundles))) AS j, unnest(page.layout.bundles) AS bundle FROM p),
t AS (SELECT record_id, i, j, unnest(range(len(bundle.tokens))) AS k, unnest(bundle.tokens) AS token FROM b),
r AS (SELECT record_id, i, unnest(range(len(page.layout.remaining_tokens))) AS k, unnest(page.layout.remaining_tokens) AS token FROM p)
SELECT 'layouts' AS src, record_id, 'page' AS lvl, i AS page_pos, -1 AS bundle_pos, -1 AS token_pos FROM p WHERE page IS NOT NULL
UNION ALL SELECT 'layouts', record_id, 'bundle', i, j, -1 FROM b WHERE bundle IS NOT NULL
UNION ALL SELECT 'layouts', record_id, 'token', i, j, k FROM t WHERE token IS NOT NULL
UNION ALL SELECT 'layouts', record_id, 'remaining', i, -1, k FROM r WHERE token IS NOT NULL""",
    "p6_layout_records": "SELECT 'layouts' AS src, record_id, paper_sha, CAST(coalesce(len(list_filter(pages, lambda p: p IS NOT NULL)), 0) AS INTEGER) AS pages FROM layouts",
}
