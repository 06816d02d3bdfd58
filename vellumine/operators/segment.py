"""Spans, runs and assignments along a text or a sequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.session import spread

#: Sentences that cover a text without gaps.
COVERING = r"[^.!?]*[.!?]+|[^.!?]+$"


WORD = r"[^\s]+"


@F.pandas_udf(T.ArrayType(T.LongType()))
def running_ends(lengths: pd.Series) -> pd.Series:
    """Running sums of an array of lengths."""
    return lengths.map(lambda x: None if x is None else np.cumsum(x, dtype=np.int64))


def words(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, token_id, token)``: the words between white space."""
    rows = spread(df.select(key, text), key)
    return rows.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("token_id", "token"))


def char_spans(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, token_id, token, start, end)``: words with their place in the text joined by single blanks.

    Only the words' lengths leave the JVM; the sums are taken inside the row, so nothing is shuffled.
    """
    rows = spread(df.select(key, text), key).select(key, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"))
    rows = rows.withColumn("_e", running_ends(F.transform("_w", lambda w: F.char_length(w) + 1)))
    out = rows.select(key, F.posexplode(F.arrays_zip("_w", "_e")).alias("token_id", "x"))
    return out.select(key, "token_id", F.col("x._w").alias("token"), (F.col("x._e") - 1 - F.char_length("x._w")).alias("start"), (F.col("x._e") - 1).alias("end"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _sentence_of(words_: pd.Series, sentences: pd.Series) -> pd.Series:
    """Number of each word's sentence, from the lengths of both: least overhang, the first of equals."""

    def one(w: np.ndarray | None, s: np.ndarray | None) -> np.ndarray | None:
        if w is None or s is None or not len(s):
            return None if w is None else np.full(len(w), -1, dtype=np.int32)
        end = np.cumsum(w, dtype=np.int64) - 1
        start, last = end - (np.asarray(w) - 1), np.cumsum(s, dtype=np.int64)
        first = last - np.asarray(s)
        low, high = np.searchsorted(last, start, side="right"), np.searchsorted(first, end, side="left") - 1
        out = np.where(low > high, -1, low).astype(np.int32)
        for k in np.flatnonzero(high > low):  # a word in several sentences
            cost = np.maximum(first[low[k] : high[k] + 1] - start[k], 0) + np.maximum(end[k] - last[low[k] : high[k] + 1], 0)
            out[k] = low[k] + int(cost.argmin())
        return out

    return pd.Series([one(w, s) for w, s in zip(words_, sentences, strict=True)])


def sentence_lengths(words_: Column) -> Column:
    """Lengths of the covering sentences of words joined by single blanks."""
    return F.transform(F.regexp_extract_all(F.array_join(words_, " "), F.lit(COVERING), F.lit(0)), lambda s: F.char_length(s))


def sentence_numbers(words_: Column) -> Column:
    """The number of the sentence of each of the words, which are joined by single blanks; -1 where there is none."""
    return _sentence_of(F.transform(words_, lambda w: F.char_length(w) + 1), sentence_lengths(words_))


def tokens_to_sentences(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, token_id, sent_id)``: each word's sentence, found inside the row without a join."""
    rows = spread(df.select(key, text), key).select(key, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"))
    return rows.select(key, F.posexplode(sentence_numbers(F.col("_w"))).alias("token_id", "sent_id")).where("sent_id >= 0")


def sentence_boxes(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, sent_id, row_id, box)``: the union box of each sentence's tokens in each row it runs over.

    ``tokens`` has ``keys``, ``token_id``, ``text``, ``row_id`` and a box; a page's tokens, which are bounded, are
    gathered into one row and their sentences found inside it.
    """
    box = ("x1", "y1", "x2", "y2")
    rows = tokens.where("text IS NOT NULL AND text <> ''").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("token_id", "text", "row_id", *box))).alias("t"))
    rows = rows.withColumn("n", sentence_numbers(F.transform("t", lambda x: x["text"])))
    flat = rows.select(*keys, F.explode(F.arrays_zip("t", "n")).alias("x")).select(*keys, F.col("x.n").alias("sent_id"), "x.t.row_id", *[f"x.t.{c}" for c in box]).where("sent_id >= 0")
    return flat.groupBy(*keys, "sent_id", "row_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def islands(df: DataFrame, key: str, number: str) -> DataFrame:
    """Maximal runs of consecutive numbers: ``(key, start, length)``."""
    w = Window.partitionBy(key).orderBy(number)
    marked = df.withColumn("_g", F.col(number) - F.row_number().over(w))
    return marked.groupBy(key, "_g").agg(F.min(number).alias("start"), F.count("*").alias("length")).drop("_g")


def longest_run(df: DataFrame, key: str, number: str) -> DataFrame:
    """The first of the longest runs of each key; a key without numbers has none."""
    best = F.max_by(F.struct("start", "length"), F.struct(F.col("length"), (-F.col("start")).alias("s")))
    return islands(df, key, number).groupBy(key).agg(best.alias("r")).select(key, "r.start", "r.length")


def span_match(span: Column, token: Column) -> Column:
    """Place of a token in a span after both are normalised, 0-based, -1 if absent."""
    clean = F.regexp_replace(span, " - ", "-")
    return F.instr(F.lower(clean), F.lower(F.regexp_replace(token, r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", ""))) - 1


def span_boxes(tokens: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes of a span of text on a page, one per row it runs over.

    ``tokens`` has ``keys``, ``token_id``, ``text``, a box and ``row_id``; ``spans`` has ``keys``, ``span_id``
    and ``span``. Tokens found in the span are taken; of them the first longest run of consecutive ones
    counts. A span without any token gives no rows.
    """
    hits = tokens.join(spans, keys).where(F.col("text").isNotNull() & (F.col("text") != "") & (span_match(F.col("span"), F.col("text")) >= 0))
    w = Window.partitionBy(*keys, "span_id").orderBy("token_id")
    hits = hits.withColumn("_g", F.col("token_id") - F.row_number().over(w))
    runs = hits.groupBy(*keys, "span_id", "_g").agg(F.count("*").alias("n"), F.min("token_id").alias("first"))
    best = runs.groupBy(*keys, "span_id").agg(F.max_by("_g", F.struct("n", (-F.col("first")).alias("f"))).alias("_g"))
    kept = hits.join(best, [*keys, "span_id", "_g"], "left_semi")
    return kept.groupBy(*keys, "span_id", "row_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def in_chunks(numbers: DataFrame, chunks: DataFrame, key: str, number: str = "token_id", cell: int = 256) -> DataFrame:
    """The first chunk ``[start, start + length)`` that holds each number; a range join over cells of the sequence."""
    n = numbers.select(key, F.col(number), F.expr(f"{number} div {cell}").alias("_cell"))
    c = chunks.select(key, F.col("start").alias("_s"), (F.col("start") + F.col("length")).alias("_e")).withColumn("_cell", F.explode(F.sequence(F.expr(f"_s div {cell}"), F.expr(f"(_e - 1) div {cell}"))))
    return n.join(c, [key, "_cell"]).where((F.col(number) >= F.col("_s")) & (F.col(number) < F.col("_e"))).groupBy(key, number).agg(F.min("_s").alias("chunk"))
