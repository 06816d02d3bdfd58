"""Problem 4: the N best items of every group by simultaneous bisection.

Every group keeps an interval of an order-preserving code (score, then position, then identifier);
a pass counts each group's rows above the midpoints of its interval, all groups at once. Rows above
the crossing cell are taken, rows below it are dropped, only the rows of the crossing cell go into
the next pass. The passes end when every group holds exactly N.

Groups are never gathered: a group with more rows than ``unit_rows`` is salted into units, every unit is
bisected by itself, and the units' winners are bisected once more. The table of such groups is broadcast
up to ``MOST_HOT`` entries; a longer one is joined with rows that are spread over ``SPREAD`` copies of it,
so that no group's rows meet in one task.

Defined results: rows without identifier, group or score, and scores that are NaN or outside 0..1,
take no part; a missing position comes after all others; of repeated rows with one identifier the
latest counts (ties in time: higher score, lower position, then label and paper); an empty table
gives no rows; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.session import Stored

CELLS = 64
UNIT_ROWS = 250_000
MOST_HOT = 20_000
SPREAD = 64
CODES = ("c0", "c1", "c2", "c3")


def normal_label(label: Column) -> Column:
    """The part before ``_``, capitalised."""
    part = F.substring_index(label, "_", 1)
    return F.concat(F.upper(F.substring(part, 1, 1)), F.lower(part.substr(F.lit(2), F.char_length(part))))


def latest(preds: DataFrame, *more: str) -> DataFrame:
    """One row per ``pred_id``, the latest by ``scored_at``."""
    w = Window.partitionBy("pred_id").orderBy(
        F.col("scored_at").desc_nulls_last(), F.col("prob").desc_nulls_last(), F.col("pos").asc_nulls_last(),
        F.col("label").asc_nulls_last(), F.col("paper_id").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in more])
    cols = ["pred_id", "paper_id", "label", "pos", "prob", "scored_at", *more]
    return (preds.where("pred_id IS NOT NULL").select(*cols)
            .withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "scored_at"))


def candidates(preds: DataFrame, *more: str) -> DataFrame:
    """Rows that take part, with labels in the normal form."""
    ok = "paper_id IS NOT NULL AND label IS NOT NULL AND prob IS NOT NULL AND NOT isnan(prob) AND prob >= 0 AND prob <= 1"
    return latest(preds, *more).where(ok).withColumn("label", normal_label(F.col("label")))


def _coded(rows: DataFrame) -> DataFrame:
    """Codes of which larger is better; all are exact as doubles."""
    return rows.select(
        "paper_id", "label", "pred_id",
        (F.col("prob") + F.lit(0.0)).alias("c0"),
        (-F.coalesce(F.col("pos").cast("double"), F.lit(2147483648.0))).alias("c1"),
        (-F.shiftright("pred_id", 32).cast("double")).alias("c2"),
        (-F.col("pred_id").bitwiseAND(F.lit(0xFFFFFFFF)).cast("double")).alias("c3"),
    )


def _by_level(prefix: str = "c") -> Column:
    out = F.when(F.col("level") == 0, F.col(f"{prefix}0"))
    for k in (1, 2, 3):
        out = out.when(F.col("level") == k, F.col(f"{prefix}{k}"))
    return out


def _pass(active: DataFrame, keys: list[str]) -> DataFrame:
    """One bisection of all groups: rows taken (``need`` null) and rows still open."""
    value = _by_level()
    cell = F.least(F.lit(CELLS - 1), F.floor((value - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS).cast("int"))
    placed = active.withColumn("cell", cell).repartition(*keys)
    counts = placed.groupBy(*keys, "cell").agg(
        F.count("*").alias("n"), F.first("need").alias("need"),
        *[F.min(c).alias(f"lo{c[1]}") for c in CODES], *[F.max(c).alias(f"hi{c[1]}") for c in CODES])
    w = Window.partitionBy(*keys).orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = Window.partitionBy(*keys)
    # the crossing cell: the highest at which enough rows lie at or above; if none, all are taken
    cells = counts.withColumn("upto", F.sum("n").over(w))
    cells = cells.withColumn("total", F.sum("n").over(last))
    crossing = cells.where("(upto >= need AND upto - n < need) OR (total < need AND upto = total)")
    level = F.expr("CASE WHEN lo0 < hi0 THEN 0 WHEN lo1 < hi1 THEN 1 WHEN lo2 < hi2 THEN 2 ELSE 3 END")
    state = crossing.select(
        *keys, F.col("cell").alias("_cell"),
        F.when((F.col("upto") > F.col("need")), F.col("need") - (F.col("upto") - F.col("n"))).alias("_need"),
        level.alias("_level"), *[f"lo{k}" for k in range(4)], *[f"hi{k}" for k in range(4)])
    joined = placed.join(state, keys).where("cell >= _cell")
    is_open = F.expr("cell = _cell AND _need IS NOT NULL")
    return joined.select(
        *keys, "pred_id", *CODES,
        F.when(is_open, F.col("_need")).alias("need"),
        F.when(is_open, F.col("_level")).alias("level"),
        *[F.when(is_open, F.expr(f"CASE _level WHEN 0 THEN {s}0 WHEN 1 THEN {s}1 WHEN 2 THEN {s}2 ELSE {s}3 END")).alias(s) for s in ("lo", "hi")])


def bisect(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` best coded rows of each group of ``keys``; ``pred_id`` is unique."""
    spark = rows.sparkSession
    active = (rows.withColumn("need", F.lit(n).cast("long")).withColumn("level", F.lit(0))
              .withColumn("lo", F.lit(0.0)).withColumn("hi", F.lit(1.0)))
    taken: list[DataFrame] = []
    while True:
        done = Stored(_pass(active, keys))
        taken.append(done.df.where("need IS NULL").select(*keys, "pred_id", *CODES))
        active = done.df.where("need IS NOT NULL")
        if active.isEmpty():
            break
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def top_n(rows: DataFrame, n: int = 5, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """``(paper_id, label, pred_id)`` of the ``n`` best rows of each paper and label.

    ``rows`` has ``paper_id, label, pred_id, pos, prob`` and one row per ``pred_id``.
    """
    coded = _coded(rows)
    sizes = rows.groupBy("paper_id", "label").agg(F.count("*").alias("rows"))
    hot = Stored(sizes.where(F.col("rows") > unit_rows).select("paper_id", "label", F.ceil(F.col("rows") / unit_rows).cast("int").alias("salts")))
    entries = hot.df.count()
    if not entries:
        return bisect(coded, ["paper_id", "label"], n).select("paper_id", "label", "pred_id")
    first = bisect(_salted(coded, hot.df, entries), ["paper_id", "label", "salt"], n)
    # a unit's number is 0 for groups that were not split
    again = bisect(first.where("salt > 0").drop("salt"), ["paper_id", "label"], n)
    return first.where("salt = 0").select("paper_id", "label", "pred_id").unionByName(again.select("paper_id", "label", "pred_id"))


def _salted(coded: DataFrame, hot: DataFrame, entries: int) -> DataFrame:
    """Rows with their unit in ``salt``: from 1 on in the groups of ``hot``, 0 in all others."""
    keys = ["paper_id", "label"]
    if entries <= MOST_HOT:
        joined = coded.join(F.broadcast(hot), keys, "left")
    else:
        copies = hot.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        joined = coded.withColumn("_copy", F.pmod(F.xxhash64(F.lit(3), "pred_id"), F.lit(SPREAD)).cast("int")).join(copies, [*keys, "_copy"], "left").drop("_copy")
    salt = F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("pred_id"), F.col("salts")).cast("int") + 1)
    return joined.withColumn("salt", salt).drop("salts")


def top_predictions(preds: DataFrame, n: int = 5, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """The top ``n`` of each paper and label from raw predictions.

    The cleaned rows are stored once, so passes read a narrow table instead of the sentences.
    """
    return top_n(Stored(candidates(preds)).df, n, unit_rows)


def found(top: DataFrame) -> DataFrame:
    """Members of the top N."""
    return top.select("pred_id")


def with_sentences(preds: DataFrame, top: DataFrame) -> DataFrame:
    """The chosen predictions with their sentence, as delivered last."""
    return candidates(preds, "sentence").join(top.select("pred_id"), "pred_id", "left_semi")
