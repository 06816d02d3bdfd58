"""Queries over sentences, sections and facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions import lexicon as lx
from vellumine.functions import text as tx
from vellumine.operators import facets
from vellumine.plans import sqlviews as v
from vellumine.session import spread
from vellumine.sources import canonical
from vellumine.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _re(*roots: str) -> str:
    return f"regexp_matches(lower(text), '{lx.pattern(*roots)}')"


def _has(col: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


def _sec(name: str) -> str:
    return f"coalesce({_has('section', tx.SECTION_WORDS[name])}, false)"


_EXPECTED = {
    "Contribution": _sec("introduction"), "Objective": f"({_sec('introduction')} OR {_sec('conclusion')})", "Novelty": f"({_sec('related_work')} OR {_sec('introduction')})",
    "Result": f"({_sec('introduction')} OR {_sec('result')} OR {_sec('discussion')} OR {_sec('conclusion')})", "Conclusion": f"({_sec('conclusion')} OR {_sec('discussion')})",
    "Future Work": f"({_sec('introduction')} OR {_sec('conclusion')} OR {_sec('discussion')} OR {_sec('future_work')})",
    "Method": f"NOT ({_sec('related_work')} OR {_sec('result')} OR {_sec('future_work')} OR {_sec('discussion')})",
}


@query(f"SELECT doc_id, {v.CLEAN.format('text')} AS cleaned FROM documents WHERE text IS NOT NULL")
def clean_sentence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", tx.clean_sentence(F.col("text")).alias("cleaned"))


@query(v.DOCS + " SELECT doc_id, sent_id, block_id, text FROM sents")
def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    return canonical.doc_sentences(spark, d)


@query("SELECT input_id, i AS pos, s AS sentence FROM (SELECT input_id, scope, unnest(range(len(sentences))) AS i, unnest(sentences) AS s FROM ssc_input) WHERE s IS NOT NULL AND (scope = 'abstract' OR length(s) >= 10)")
def min_len(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ssc_input").select("input_id", "scope", F.posexplode("sentences").alias("pos", "sentence"))
    return rows.where("sentence IS NOT NULL AND (scope = 'abstract' OR char_length(sentence) >= 10)").select("input_id", "pos", "sentence")


BLOCKED = ("CCS Concepts", "Additional Key Words and Phrases")


@query("SELECT doc_id FROM documents WHERE kind = 'abstract' AND text IS NOT NULL AND NOT contains(text, 'CCS Concepts') AND NOT contains(text, 'Additional Key Words and Phrases')")
def abstract_blocklist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("kind = 'abstract' AND text IS NOT NULL").where(~tx.any_contains(F.col("text"), BLOCKED)).select("doc_id")


_TERMS = lx.terms("suggest", "consistent", "likely", "need")


@query(v.PAPERS + f", t AS (SELECT *, list_filter([{', '.join(f'CASE WHEN regexp_matches(lower(text), $q$\\b{t}\\b$q$) THEN $q${t}$q$ END' for t in _TERMS)}], lambda x: x IS NOT NULL) AS ts FROM sents) SELECT block_id, sent_id, array_to_string(ts, '|') AS terms FROM t WHERE len(ts) > 0")
def lexicon_terms(spark: SparkSession, d: str) -> DataFrame:
    s = canonical.paper_sentences(spark, d).where(lx.matches(F.lower("text"), "suggest", "consistent", "likely", "need"))
    return s.select("block_id", "sent_id", F.array_join(lx.found_terms(F.lower("text"), "suggest", "consistent", "likely", "need"), "|").alias("terms"))


@query("SELECT section_id, " + ", ".join(f"coalesce({_has('header', w)}, false) AS is_{n}" for n, w in tx.SECTION_WORDS.items()) + " FROM sections")
def section_predicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").select("section_id", *[tx.is_section(F.col("header"), n).alias(f"is_{n}") for n in tx.SECTION_WORDS])


@query("SELECT paper_id, bool_or(coalesce(contains(lower(header), 'conclusion') OR contains(lower(header), 'concluding'), false)) AS has_conclusion FROM sections WHERE paper_id IS NOT NULL GROUP BY paper_id")
def has_section(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").where("paper_id IS NOT NULL").groupBy("paper_id").agg(F.bool_or(tx.is_section(F.col("header"), "conclusion")).alias("has_conclusion"))


@query("WITH s AS (SELECT section_id, lower(header) AS section FROM sections) SELECT section_id, " + ", ".join(f"{e} AS {n.lower().replace(' ', '_')}" for n, e in _EXPECTED.items()) + " FROM s")
def expected_section_matrix(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sections").select("section_id", F.lower("header").alias("section"))
    return s.select("section_id", *[tx.expected_section(F.col("section"), n).alias(n.lower().replace(" ", "_")) for n in _EXPECTED])


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'fig.') OR contains(lower(text), 'figure') THEN 'figure' WHEN contains(lower(text), 'tab.') OR contains(lower(text), 'table') THEN 'table' ELSE '' END AS media FROM documents WHERE kind = 'caption'")
def media_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("kind = 'caption'").select("doc_id", tx.media_type(F.col("text")).alias("media"))


@query(r"SELECT section_id, regexp_extract(header, '[-+]?\d*\.\d+|\d+', 0) AS number, regexp_extract(header, '^\d+(\.\d+)*', 0) AS strict_number FROM sections WHERE header IS NOT NULL")
def section_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").where("header IS NOT NULL").select("section_id", tx.section_number(F.col("header")).alias("number"), tx.strict_section_number(F.col("header")).alias("strict_number"))


@query(r"""WITH n AS (SELECT paper_id, section_id AS block_id, pos, header, regexp_extract(header, '[-+]?\d*\.\d+|\d+', 0) AS number FROM sections WHERE paper_id IS NOT NULL AND header IS NOT NULL),
top AS (SELECT paper_id, number, arg_max(header, {'a': coalesce(pos, -2147483648), 'b': block_id}) AS parent FROM n WHERE number <> '' GROUP BY 1, 2)
SELECT n.paper_id, n.block_id, n.header, n.number, CASE WHEN contains(n.number, '.') THEN coalesce(top.parent, '') || ' @@ ' || n.header ELSE n.header END AS path
FROM n LEFT JOIN top ON top.paper_id = n.paper_id AND contains(n.number, '.') AND top.number = split_part(n.number, '.', 1)""")
def section_paths(spark: SparkSession, d: str) -> DataFrame:
    return facets.section_paths(table(spark, d, "sections").select("paper_id", F.col("section_id").alias("block_id"), "pos", "header"))


@query("SELECT section_id, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY pos, section_id ROWS UNBOUNDED PRECEDING), '') AS carried FROM sections WHERE paper_id IS NOT NULL AND pos IS NOT NULL")
def section_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sections").where("paper_id IS NOT NULL AND pos IS NOT NULL").select("section_id", "paper_id", "pos", "header")
    return facets.carry_forward(rows, "paper_id", ["pos", "section_id"], "header").select("section_id", "carried")


@query(v.DOCS + r" SELECT doc_id, sent_id FROM sents WHERE list_has_any(regexp_split_to_array(lower(text), '\s+'), ['we', 'our']) OR contains(lower(text), 'this paper')")
def author_loose(spark: SparkSession, d: str) -> DataFrame:
    return canonical.doc_sentences(spark, d).where(tx.author_statement(F.col("text"))).select("doc_id", "sent_id")


@query(v.PAPERS + r""", h AS (SELECT paper_id, block_id, max(CASE WHEN sent_id = 0 THEN text END) AS s0, max(CASE WHEN sent_id = 1 THEN text END) AS s1 FROM sents WHERE sent_id < 2 GROUP BY 1, 2),
o AS (SELECT paper_id, block_id, CASE WHEN regexp_matches(s0, '^\p{Lu}') THEN s0 WHEN regexp_matches(s0, '^\p{Nd}') AND regexp_matches(s1, '^\p{Lu}') THEN s1 END AS text FROM h)
SELECT * FROM o WHERE length(text) >= 15""")
def first_sentence(spark: SparkSession, d: str) -> DataFrame:
    return facets.first_sentences(canonical.paper_sentences(spark, d))


def _facet_sql(label: str, where: str, prob: str = "CAST(NULL AS DOUBLE)", source: str = "sents", section: str = "section", expected: str | None = None) -> str:
    return f"SELECT paper_id, block_id, sent_id, text, '{label}' AS label, {section} AS section, {prob} AS prob, {_re('we')} AS is_author_statement, {expected or _EXPECTED[label]} AS is_in_expected_section FROM {source} WHERE {where}"


_CONC = f"CASE WHEN {_re('conclude')} THEN 1.0 WHEN {_re('suggest', 'thus', 'likely', 'because')} THEN 0.5 END"
_FIRST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, block_id ORDER BY sent_id) AS k FROM sents WHERE {_re('we')}) WHERE k = 1)"
_FACETS = {
    "author": _facet_sql("Author", _re("we"), section="CAST(NULL AS VARCHAR)", expected="true"),
    "contribution": _facet_sql("Contribution", _re("contribution")),
    "novelty": _facet_sql("Novelty", _re("inconsistent", "however", "extend")),
    "objective": _facet_sql("Objective", f"({_re('aim', 'question')} OR {_re('investigate')})"),
    "method": _facet_sql("Method", "true", source=_FIRST),
    "result": _facet_sql("Result", _re("observe")),
    "conclusion": _facet_sql("Conclusion", f"{_CONC} IS NOT NULL", _CONC),
    "future_work": _facet_sql("Future Work", _re("will", "need", "future")),
}
for _name, _detector in facets.ORDER:
    QUERIES[f"facet_{_name}"] = lambda spark, d, f=_detector: f(canonical.paper_sentences(spark, d))
    SQL[f"facet_{_name}"] = v.PAPERS + " " + _FACETS[_name]
SQL["facet_all"] = v.PAPERS + " " + " UNION ALL ".join(_FACETS.values())


def _marked(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "sections").where("body IS NOT NULL"), "section_id")
    return canonical.section_sentences(rows, lambda low: lx.matches(low, "we"))


def facet_all(spark: SparkSession, d: str) -> DataFrame:
    return facets.all_facets(_marked(spark, d))


QUERIES["facet_all"] = facet_all


@query(v.PAPERS + f" SELECT paper_id, block_id, min(sent_id) AS sent_id FROM sents WHERE {_re('we')} GROUP BY 1, 2")
def first_author_per_block(spark: SparkSession, d: str) -> DataFrame:
    return facets.first_author_per_block(canonical.paper_sentences(spark, d)).select("paper_id", "block_id", "sent_id")


@query("SELECT label, count(*) AS n FROM (" + v.PAPERS + " " + " UNION ALL ".join(_FACETS.values()) + ") GROUP BY label")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return facets.all_facets(_marked(spark, d)).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT section_id, length(body) AS n, CASE WHEN length(body) > 10 AND length(body) < 600 THEN body ELSE 'BADSENTENCE' END AS body, CASE WHEN length(body) > 10 AND length(body) < 600 THEN 1.0 ELSE 1e-6 END AS score FROM sections WHERE body IS NOT NULL")
def bad_sentence(spark: SparkSession, d: str) -> DataFrame:
    good = F.char_length("body").between(11, 599)
    return table(spark, d, "sections").where("body IS NOT NULL").select(
        "section_id", F.char_length("body").alias("n"), F.when(good, F.col("body")).otherwise("BADSENTENCE").alias("body"), F.when(good, 1.0).otherwise(1e-6).alias("score"))


@query("SELECT vec_id, CASE WHEN embedding[1] > 0 THEN CAST(embedding[1] AS DOUBLE) ELSE 1e-6 END AS score FROM embeddings")
def score_floor(spark: SparkSession, d: str) -> DataFrame:
    x = F.get("embedding", 0).cast("double")
    return table(spark, d, "embeddings").select("vec_id", F.when(x > 0, x).otherwise(1e-6).alias("score"))


@query("SELECT DISTINCT lower(header) AS section FROM sections WHERE header IS NOT NULL")
def distinct_sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").where("header IS NOT NULL").select(F.lower("header").alias("section")).distinct()


@query("SELECT pred_id, upper(substr(split_part(label, '_', 1), 1, 1)) || lower(substr(split_part(label, '_', 1), 2)) AS label FROM ssc_preds WHERE label IS NOT NULL")
def normal_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ssc_preds").where("label IS NOT NULL").select("pred_id", tx.normal_label(F.col("label")).alias("label"))


@query("SELECT paper_id, id, pub_year FROM papers WHERE pub_year IS NOT NULL AND pub_year <> 0 AND paper_sha IS NOT NULL AND paper_sha <> '' AND pub_year = 2016")
def papers_of_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").where("pub_year IS NOT NULL AND pub_year <> 0 AND paper_sha IS NOT NULL AND paper_sha <> '' AND pub_year = 2016").select("paper_id", "id", "pub_year")
