"""Scores of predictions against truth; all from one grouped count of (truth, prediction) pairs.

The confusion table has at most labels x labels rows, so the work beyond the first aggregate is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, truth: str = "gt", guess: str = "pred", weight: Column | None = None) -> DataFrame:
    """``(gt, pred, n, w)``; null predictions are a class of their own."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return rows.groupBy(F.col(truth).alias("gt"), F.col(guess).alias("pred")).agg(F.count("*").alias("n"), F.sum(w).alias("w"))


def accuracy(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.when(F.col("gt").eqNullSafe(F.col("pred")), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def by_class(table: DataFrame, weight: str = "n") -> DataFrame:
    """Precision, recall, F1 and support of every class of the truth; 0 where undefined."""
    hit = F.when(F.col("gt") == F.col("pred"), F.col(weight)).otherwise(0)
    t = table.groupBy("gt").agg(F.sum(hit).alias("tp"), F.sum(weight).alias("support"))
    p = table.where("pred IS NOT NULL").groupBy(F.col("pred").alias("gt")).agg(F.sum(weight).alias("guessed"))
    both = t.join(p, "gt", "left").withColumn("guessed", F.coalesce("guessed", F.lit(0)))
    out = both.withColumn("precision", _safe(F.col("tp"), F.col("guessed"))).withColumn("recall", _safe(F.col("tp"), F.col("support")))
    return out.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select(F.col("gt").alias("label"), "precision", "recall", "f1", "support")


def micro(table: DataFrame) -> DataFrame:
    tp = F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0))
    return table.agg((tp / F.sum(F.when(F.col("pred").isNotNull(), F.col("n")))).alias("precision"), (tp / F.sum("n")).alias("recall")).withColumn(
        "f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro(table: DataFrame) -> DataFrame:
    return by_class(table).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("classes"))


def weighted(table: DataFrame, weight: str = "w") -> DataFrame:
    c = by_class(table, weight)
    return c.agg(*[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in ("precision", "recall", "f1")])


def class_weights(labels: DataFrame, label: str) -> DataFrame:
    """``-ln`` of the share of each label."""
    n = labels.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per label
    return n.select("label", "n", (-F.log(F.col("n") / total)).alias("weight"))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; a whole row of the table is one integer, a bit a place of ``a``."""
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def rouge_l_score(candidate: str | None, references: list[str | None], beta: float = 1.2) -> float:
    """Best recall and best precision over the references, each by itself; 0 if either is 0."""
    c = candidate.split(" ") if candidate else []
    p = r = 0.0
    for ref in references:
        t = ref.split(" ") if ref else []
        if c and t:
            n = lcs(c, t)
            p, r = max(p, n / len(c)), max(r, n / len(t))
    return (1 + beta**2) * p * r / (r + beta**2 * p) if p and r else 0.0


def rouge_l(rows: DataFrame, keys: list[str], candidate: str, references: str, beta: float = 1.2) -> DataFrame:
    """``keys`` and ``rouge`` of each row, whose references are an array."""
    schema = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes) + ", rouge double"

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = pdf[keys].copy()
            out["rouge"] = [rouge_l_score(c, list(r) if r is not None else [], beta) for c, r in zip(pdf[candidate], pdf[references], strict=True)]
            yield out

    return rows.select(*keys, candidate, references).mapInPandas(batches, schema)


def beside_truth(truth: DataFrame, predictors: dict[str, DataFrame], keys: list[str], missing: str) -> DataFrame:
    """``(keys, gt, predictor, pred)``: each predictor's label of each true item; ``missing`` where it has none.

    The predictors are stacked first, so the truth is read for one join however many there are.
    """
    stacked = None
    for name, rows in predictors.items():
        part = rows.select(*keys, F.lit(name).alias("predictor"), "pred")
        stacked = part if stacked is None else stacked.unionByName(part)
    wanted = truth.select(*keys, "gt", F.explode(F.array(*[F.lit(n) for n in predictors])).alias("predictor"))
    return wanted.join(stacked, [*keys, "predictor"], "left").select(*keys, "gt", "predictor", F.coalesce("pred", F.lit(missing)).alias("pred"))
