"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumine.llm import mixing, ocr, packing, pii, quality, sentences, splitting, topn
from vellumine.session import stored_result
from vellumine.sources.tables import table


def p1_units(spark: SparkSession, d: str) -> DataFrame:
    rows = sentences.texts(table(spark, d, "sections"), table(spark, d, "ssc_input"))
    return sentences.sentence_units(rows, sentences.openers(rows))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = sentences.texts(table(spark, d, "sections"), table(spark, d, "ssc_input"))
    return sentences.found(sentences.sentence_units(rows.where("pdf_kind = 'digital'"), sentences.openers(rows)))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(splitting.items(table(spark, d, "sections"), table(spark, d, "ssc_input")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.found(p2_pieces(spark, d))


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    return quality.judged(quality.values(table(spark, d, "sections")), quality.common_words(table(spark, d, "common_words")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.found(p3_scores(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.found(topn.top_predictions(table(spark, d, "ssc_preds")))


def p4_sentences(spark: SparkSession, d: str) -> DataFrame:
    preds = table(spark, d, "ssc_preds")
    return topn.with_sentences(preds, topn.top_predictions(preds))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.Noise(table(spark, d, "sections"), table(spark, d, "ssc_input")).found()


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return ocr.Noise(table(spark, d, "sections"), table(spark, d, "ssc_input")).repaired()


def p7_placements(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.sized(table(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.found(p7_placements(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_placements(spark, d))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, list[dict]]:
    sizes = mixing.sized(table(spark, d, "documents"))
    plan = mixing.quotas(sizes, table(spark, d, "mix_targets"))
    return mixing.mix(sizes, plan), plan


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*_mix(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    mixed, plan = _mix(spark, d)
    return mixing.found(mixing.stored_report(mixed, plan))


def p9_details(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return pii.details(documents, pii.name_lexicon(documents, table(spark, d, "given_names")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(p9_details(spark, d))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return pii.redacted(documents, pii.name_lexicon(documents, table(spark, d, "given_names")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    eager = (p3_scores, p3_found, p4_found, p4_sentences, p5_found, p5_repaired, p7_placements, p7_found, p7_fill, p8_mix, p8_report, p8_found, p9_details, p9_found, p9_redacted)
    lazy = (p1_found, p1_units, p2_found, p2_pieces)
    return {f.__name__: f for f in lazy} | {f.__name__: stored_result(f) for f in eager}

