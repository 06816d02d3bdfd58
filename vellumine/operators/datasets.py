"""Samples, splits and label maps; every choice is by a hash of the key, so it's the same each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.session import global_index


def shuffled(key: str, seed: str) -> Column:
    """A hash that orders rows at random."""
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def sample_n(rows: DataFrame, key: str, n: int, seed: str = "s") -> DataFrame:
    """``n`` rows without replacement; Spark keeps ``n`` of each partition."""
    return rows.orderBy(shuffled(key, seed), key).limit(n)


def split(rows: DataFrame, key: str, train: float = 0.7, valid: float = 0.15, seed: str = "452") -> DataFrame:
    """``part``: train, dev or test by rank in hash order; shares are cut to whole rows, the rest is test."""
    ranked = global_index(rows.withColumn("_h", shuffled(key, seed)), ["_h", key], "_rank")
    n = ranked.count()
    a, b = int(n * train), int(n * train) + int(n * valid)
    return ranked.withColumn("part", F.when(F.col("_rank") < a, "train").when(F.col("_rank") < b, "dev").otherwise("test")).drop("_h", "_rank")


def every_nth(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Every ``n``-th row by key, the first included."""
    return global_index(rows, [key], "_rank").where(F.col("_rank") % n == 0).drop("_rank")


def label_ids(rows: DataFrame, label: str, order: str) -> DataFrame:
    """``(label, id, n)``; ids in the order the labels are met first."""
    seen = rows.groupBy(F.col(label).alias("label")).agg(F.min(order).alias("_first"), F.count("*").alias("n"))
    # one row per label
    return seen.withColumn("id", F.row_number().over(Window.orderBy("_first")) - 1).drop("_first")


def head_per_group(rows: DataFrame, keys: list[str], key: str, n: int, seed: str = "h") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(shuffled(key, seed), key)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
