"""Ranking: top-k by group, group-capped top-k, argmax, lexicographic order.

Every rank carries a last key that makes it total. Limits sit on the rank, so Spark prunes each group
before the shuffle and a group with very many rows never meets in one task as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k_group_capped(rows: DataFrame, label: str, per_block: int = 1, overall: int | None = None) -> DataFrame:
    """Best predictions of a label with at most ``per_block`` of a block.

    With ``overall`` a paper's output ends before its ``overall``-th distinct block begins, so at most
    ``overall - 1`` blocks give rows.
    """
    order = [F.col("prob").desc(), F.col("pos"), F.col("pred_id")]
    kept = top_k(rows.where(F.col("label") == label), ["paper_id", "block_id"], order, per_block)
    if overall is None:
        return kept.drop("rank")
    key = F.struct((-F.col("prob")).alias("p"), F.col("pos"), F.col("pred_id"))
    opens = top_k(kept.where("rank = 1").withColumnRenamed("rank", "_r"), ["paper_id"], order, overall).where(F.col("rank") == overall)
    ends = opens.select("paper_id", key.alias("_end"))
    return kept.join(ends, "paper_id", "left").where(F.col("_end").isNull() | (key < F.col("_end"))).drop("rank", "_end")


def softmax(logits: Column) -> Column:
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(values: Column) -> Column:
    """0-based place of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
