"""Canonical relational tables derived from the stored tables, one scan each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions import text as tx
from vellumine.session import spread
from vellumine.sources.tables import table

SENTENCE = r"[^.!?\n]+[.!?]*"


def _box(c: Column) -> list[Column]:
    return [F.get(c, k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]


def _whole(c: Column) -> Column:
    """A box of four numbers."""
    return (F.size(c) == 4) & F.forall(c, lambda v: v.isNotNull())


def pages(spark: SparkSession, d: str) -> DataFrame:
    """``(record_id, page_pos, width, height, index)``."""
    return table(spark, d, "layouts").select("record_id", F.posexplode("pages").alias("page_pos", "p")).where("p IS NOT NULL").select(
        "record_id", "page_pos", "p.width", "p.height", "p.index")


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Typed blocks with ``block_id``, the place in the page."""
    p = table(spark, d, "layouts").select("record_id", F.posexplode("pages").alias("page_pos", "p"))
    b = p.select("record_id", "page_pos", F.posexplode("p.layout.bundles").alias("block_id", "b")).where(_whole(F.col("b.bbox")))
    return b.select("record_id", "page_pos", "block_id", "b.type", *_box(F.col("b.bbox")), "b.confidence")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens with ``parent`` (null for remaining ones) and ``token_id``, the running number in the page.

    A page's tokens are numbered inside its nested row, bundle by bundle and then the remaining ones, so
    no shuffle is needed.
    """
    p = table(spark, d, "layouts").select("record_id", F.posexplode("pages").alias("page_pos", "p")).where("p IS NOT NULL")
    empty = F.array().cast("array<struct<parent:int,t:struct<bbox:array<double>,text:string,type:string,confidence:double>>>")
    own = F.flatten(F.filter(F.transform("p.layout.bundles", lambda b, i: F.transform(b["tokens"], lambda t: F.struct(i.cast("int").alias("parent"), t.alias("t")))), lambda x: x.isNotNull()))
    rest = F.transform("p.layout.remaining_tokens", lambda t: F.struct(F.lit(None).cast("int").alias("parent"), t.alias("t")))
    every = F.filter(F.concat(F.coalesce(own, empty), F.coalesce(rest, empty)), lambda x: _whole(x["t"]["bbox"]))
    rows = p.select("record_id", "page_pos", F.col("p.width").alias("pw"), F.col("p.height").alias("ph"), F.posexplode(every).alias("token_id", "x"))
    return rows.select("record_id", "page_pos", "token_id", "x.parent", "x.t.text", "x.t.type", "x.t.confidence", *_box(F.col("x.t.bbox")), "pw", "ph")


def split_sentences(df: DataFrame, text: Column, *keys: str) -> DataFrame:
    """``(keys, sent_id, text)``: rule-based sentences of cleaned text, blank ones left out."""
    found = F.regexp_extract_all(tx.clean_sentence(text), F.lit(SENTENCE), F.lit(0))
    return df.select(*keys, F.posexplode(found).alias("sent_id", "s")).select(*keys, "sent_id", tx.strip(F.col("s")).alias("text")).where("text <> ''")


def doc_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of documents; five make a block."""
    rows = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return split_sentences(rows, F.col("text"), "doc_id").withColumn("block_id", F.expr("sent_id div 5"))


def paper_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Body sentences with their section: ``(paper_id, block_id, sent_id, text, section)``.

    A section row is a block; its header in lower case is the section.
    """
    return section_sentences(spread(table(spark, d, "sections").where("body IS NOT NULL"), "section_id"))


def section_sentences(sections: DataFrame, author: Callable[[Column], Column] | None = None) -> DataFrame:
    """The sentences of ``sections``; with ``author``, ``first_we`` is the number of the first for which it holds in the row."""
    keys = ["paper_id", "block_id", "section"]
    rows = sections.select("paper_id", F.col("section_id").alias("block_id"), F.lower("header").alias("section"), "body")
    if author is None:
        return split_sentences(rows, F.col("body"), *keys).select("paper_id", "block_id", "sent_id", "text", "section")
    # one list of sentences a row serves both: the first author sentence is found before the list is taken apart
    found = F.transform(F.regexp_extract_all(tx.clean_sentence(F.col("body")), F.lit(SENTENCE), F.lit(0)), tx.strip)
    rows = rows.select(*keys, F.transform(found, lambda t, i: F.struct(i.cast("int").alias("sent_id"), t.alias("text"), (author(F.lower(t)) & (t != "")).alias("we"))).alias("s"))
    first = F.get(F.filter("s", lambda x: x["we"]), 0)["sent_id"]
    return rows.select(*keys, first.alias("first_we"), F.explode("s").alias("x")).select("paper_id", "block_id", "x.sent_id", "x.text", "section", "first_we").where("text <> ''")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Classifier output with normal labels and usable probabilities; ten positions make a block."""
    p = table(spark, d, "ssc_preds").where("paper_id IS NOT NULL AND label IS NOT NULL AND prob IS NOT NULL AND NOT isnan(prob) AND prob BETWEEN 0 AND 1")
    return p.select("pred_id", "paper_id", "pos", "sentence", tx.normal_label(F.col("label")).alias("label"), "prob", F.expr("pos div 10").alias("block_id"), "scored_at")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Score vectors of five labels from the first five embedding values."""
    return table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 5).cast("array<double>").alias("logits"), "label")
