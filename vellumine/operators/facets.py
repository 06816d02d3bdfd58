"""Rhetorical facets: lexicon detectors over sentences, each a filter with literal columns.

``sentences`` has ``(paper_id, block_id, sent_id, text, section)``; nulls in ``section`` never match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions import lexicon as lx
from vellumine.functions import text as tx

OUT = ("paper_id", "block_id", "sent_id", "text", "label", "section", "prob", "is_author_statement", "is_in_expected_section")


def _emit(rows: DataFrame, label: str, prob: Column | None = None, section: Column | None = None, expected: Column | None = None) -> DataFrame:
    return rows.select(
        "paper_id", "block_id", "sent_id", "text", F.lit(label).alias("label"), (F.col("section") if section is None else section).alias("section"),
        (F.lit(None).cast("double") if prob is None else prob).alias("prob"), lx.matches(F.lower("text"), "we").alias("is_author_statement"),
        (tx.expected_section(F.col("section"), label) if expected is None else expected).alias("is_in_expected_section"))


def _by_lexicon(label: str, *roots: str) -> Callable[[DataFrame], DataFrame]:
    return lambda s: _emit(s.where(lx.matches(F.lower("text"), *roots)), label)


contribution = _by_lexicon("Contribution", "contribution")
novelty = _by_lexicon("Novelty", "inconsistent", "however", "extend")
result = _by_lexicon("Result", "observe")
future_work = _by_lexicon("Future Work", "will", "need", "future")


def objective(sentences: DataFrame, tagger: Callable[[Column], Column] | None = None) -> DataFrame:
    """Nouns of aim or question, or a verb of investigate.

    ``tagger`` tells from the text whether an investigate term is a verb; without one all are taken.
    """
    low = F.lower("text")
    verb = lx.matches(low, "investigate")
    if tagger is not None:
        verb = verb & tagger(F.col("text"))
    return _emit(sentences.where(lx.matches(low, "aim", "question") | verb), "Objective")


def conclusion(sentences: DataFrame) -> DataFrame:
    """A conclude term is certain, a suggest, thus, likely or because term half so."""
    low = F.lower("text")
    prob = F.when(lx.matches(low, "conclude"), 1.0).when(lx.matches(low, "suggest", "thus", "likely", "because"), 0.5)
    return _emit(sentences.withColumn("_prob", prob).where("_prob IS NOT NULL"), "Conclusion", F.col("_prob"))


def first_author_per_block(sentences: DataFrame) -> DataFrame:
    """First sentence of each block that speaks of its authors; the rank limit is pushed below the shuffle."""
    w = Window.partitionBy("paper_id", "block_id").orderBy("sent_id")
    return sentences.where(lx.matches(F.lower("text"), "we")).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def method(sentences: DataFrame) -> DataFrame:
    return _emit(first_author_per_block(sentences), "Method")


def author(sentences: DataFrame) -> DataFrame:
    return _emit(sentences.where(lx.matches(F.lower("text"), "we")), "Author", section=F.lit(None).cast("string"), expected=F.lit(True))


ORDER: tuple[tuple[str, Callable[[DataFrame], DataFrame]], ...] = (
    ("author", author), ("contribution", contribution), ("novelty", novelty), ("objective", objective), ("method", method),
    ("result", result), ("conclusion", conclusion), ("future_work", future_work))


def all_facets(sentences: DataFrame) -> DataFrame:
    """All detectors from one pass over the sentences.

    A sentence is read once and gives a row for each detector that fires. Method takes the first author
    sentence of a block: where the sentences carry ``first_we``, that sentence's number in the block, nothing
    is shuffled; else the sentences are ranked.
    """
    low = F.lower("text")
    conclude = F.when(lx.matches(low, "conclude"), 1.0).when(lx.matches(low, "suggest", "thus", "likely", "because"), 0.5)
    rules = [
        ("Author", lx.matches(low, "we"), None), ("Contribution", lx.matches(low, "contribution"), None),
        ("Novelty", lx.matches(low, "inconsistent", "however", "extend"), None),
        ("Objective", lx.matches(low, "aim", "question") | lx.matches(low, "investigate"), None),
        ("Result", lx.matches(low, "observe"), None), ("Conclusion", conclude.isNotNull(), conclude),
        ("Future Work", lx.matches(low, "will", "need", "future"), None)]
    known = "first_we" in sentences.columns
    if known:
        rules.append(("Method", F.col("sent_id") == F.col("first_we"), None))
    fired = F.array(*[F.when(rule, F.struct(
        F.lit(label).alias("label"), (F.lit(None).cast("double") if prob is None else prob).alias("prob"),
        (F.lit(None).cast("string") if label == "Author" else F.col("section")).alias("section"),
        (F.lit(True) if label == "Author" else tx.expected_section(F.col("section"), label)).alias("expected"))) for label, rule, prob in rules])
    rows = sentences.withColumn("f", F.explode(F.filter(fired, lambda x: x.isNotNull()))).select(
        "paper_id", "block_id", "sent_id", "text", "f.label", "f.section", "f.prob", lx.matches(low, "we").alias("is_author_statement"), F.col("f.expected").alias("is_in_expected_section"))
    return rows if known else rows.unionByName(method(sentences))


def selected_units(preds: DataFrame, chosen: DataFrame) -> DataFrame:
    """Facet rows of model predictions picked by ``chosen`` (``pred_id``)."""
    return preds.join(chosen.select("pred_id"), "pred_id", "left_semi").select("paper_id", "pos", "sentence", "label", "prob")


def first_sentences(sentences: DataFrame) -> DataFrame:
    """Of each block the first sentence that opens it: at least 15 characters, an upper-case start.

    A block that starts with a digit gives its second sentence, if that starts with an upper-case letter.
    """
    head = sentences.where("sent_id < 2").groupBy("paper_id", "block_id").agg(
        F.max(F.when(F.col("sent_id") == 0, F.col("text"))).alias("s0"), F.max(F.when(F.col("sent_id") == 1, F.col("text"))).alias("s1"))
    one = F.when(tx.starts_upper(F.col("s0")), F.col("s0")).when(F.col("s0").rlike(r"^\p{Nd}") & tx.starts_upper(F.col("s1")), F.col("s1"))
    return head.select("paper_id", "block_id", one.alias("text")).where("char_length(text) >= 15")


def section_paths(headers: DataFrame) -> DataFrame:
    """``(paper_id, block_id, header, number, path)`` of numbered headers.

    A number with a period names its parent, ``"{parent} @@ {header}"``; a missing parent is empty. Of
    several headers with one number the last counts. The map of numbers is aggregated before the join,
    so a paper with very many rows meets one row per number.
    """
    n = headers.where("paper_id IS NOT NULL AND header IS NOT NULL").withColumn("number", tx.section_number(F.col("header")))
    top = n.where("number <> ''").groupBy("paper_id", "number").agg(F.max_by("header", F.struct("pos", "block_id")).alias("parent"))
    rows = n.withColumn("_up", F.when(F.col("number").contains("."), F.element_at(F.split("number", r"\."), 1)))
    # headers without parent number needn't meet the map
    joined = rows.where("_up IS NOT NULL").join(top.withColumnRenamed("number", "_up"), ["paper_id", "_up"], "left")
    joined = joined.unionByName(rows.where("_up IS NULL").withColumn("parent", F.lit(None).cast("string")))
    path = F.when(F.col("_up").isNotNull(), F.concat(F.coalesce("parent", F.lit("")), F.lit(" @@ "), F.col("header"))).otherwise(F.col("header"))
    return joined.select("paper_id", "block_id", "header", "number", path.alias("path"))


def carry_forward(rows: DataFrame, key: str, order: list[str], value: str, chunk: str = "pos", width: int = 256) -> DataFrame:
    """Last non-null ``value`` up to each row of its ``key``, the empty string before any.

    Two levels: inside chunks of the order column first, then from chunk to chunk, of which there is one
    row each; no window ever holds a whole large group.
    """
    rows = rows.withColumn("_c", F.expr(f"coalesce({chunk}, -1) div {width}"))
    last = F.max_by(value, F.struct(*order))
    ends = rows.where(F.col(value).isNotNull()).groupBy(key, "_c").agg(last.alias("_last"))
    spans = rows.select(key, "_c").distinct().join(ends, [key, "_c"], "left")
    before = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(key, "_c", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    inside = Window.partitionBy(key, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.last(value, ignorenulls=True).over(inside))
    return rows.join(spans, [key, "_c"], "left").withColumn("carried", F.coalesce("_in", "_before", F.lit(""))).drop("_c", "_in", "_before")
