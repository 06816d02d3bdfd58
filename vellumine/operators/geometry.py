"""Boxes, spatial joins and row clustering as expressions and keyed range joins.

Boxes are the columns ``x1, y1, x2, y2`` in page units; ``PAGE`` keys a page, whose content is bounded.
"""

from __future__ import annotations

from functools import cmp_to_key

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["record_id", "page_pos"]


def centre(axis: str) -> Column:
    return (F.col(f"{axis}1") + F.col(f"{axis}2")) / 2


def ratio_box(width: Column, height: Column) -> list[Column]:
    """Corners to left, top, width and height as shares of the page."""
    return [(F.col("x1") / width).alias("left"), (F.col("y1") / height).alias("top"), ((F.col("x2") - F.col("x1")) / width).alias("w"), ((F.col("y2") - F.col("y1")) / height).alias("h")]


def same_row(top: Column, other: Column) -> Column:
    return F.abs(top - other) < 0.01


def inside(x: Column, y: Column, margin: float = 1.0) -> Column:
    """Whether a centre lies in the box, padded on each side, both ends included."""
    return x.between(F.col("x1") - margin, F.col("x2") + margin) & y.between(F.col("y1") - margin, F.col("y2") + margin)


def clip(width: Column, height: Column) -> list[Column]:
    """Box limited to the whole units of the page."""
    w, h = width.cast("int"), height.cast("int")
    return [F.greatest(F.lit(0.0), F.least(F.col(c), w.cast("double"))).alias(c) if c[0] == "x" else F.greatest(F.lit(0.0), F.least(F.col(c), h.cast("double"))).alias(c) for c in ("x1", "y1", "x2", "y2")]


def pad(amount: float) -> list[Column]:
    return [(F.col(c) + (amount if c[1] == "2" else -amount)).alias(c) for c in ("x1", "y1", "x2", "y2")]


def scale(fx: Column, fy: Column) -> list[Column]:
    return [(F.col(c) * (fx if c[0] == "x" else fy)).alias(c) for c in ("x1", "y1", "x2", "y2")]


def grid1000(width: Column, height: Column) -> list[Column]:
    """To the grid of 0..1000, cut to whole numbers."""
    return [(F.col(c) * 1000 / (width if c[0] == "x" else height)).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")]


def xywh() -> list[Column]:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return [F.col("x1").alias("x"), F.col("y1").alias("y"), w.alias("w"), h.alias("h"), (w * h).alias("area")]


def flip_y(height: Column) -> list[Column]:
    return [F.col("x1"), (height - F.col("y2")).alias("y1"), F.col("x2"), (height - F.col("y1")).alias("y2")]


def union_box() -> list[Column]:
    return [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]


def matches(tokens: DataFrame, blocks: DataFrame, margin: float = 1.0) -> DataFrame:
    """All (token, block) pairs of a page whose token centre lies in the block: a range join keyed by page."""
    t = tokens.select(*PAGE, "token_id", centre("x").alias("_cx"), centre("y").alias("_cy"))
    return t.join(blocks, PAGE).where(inside(F.col("_cx"), F.col("_cy"), margin)).drop("_cx", "_cy")


def assign(tokens: DataFrame, blocks: DataFrame, pick: str = "first", order: str = "block_id") -> DataFrame:
    """``(page, token_id, block_id)``: the first or last block, in ``order``, that holds each token; null if none.

    The first containing block is what a greedy pass over the blocks gives, since it takes a token once.
    """
    t = tokens.select(*PAGE, "token_id", centre("x").alias("_cx"), centre("y").alias("_cy"))
    b = blocks.select(*[F.col(k).alias(f"_{k}") for k in PAGE], F.col(order).alias("_ord"), "block_id", "x1", "y1", "x2", "y2")
    same_page = (t[PAGE[0]] == b[f"_{PAGE[0]}"]) & (t[PAGE[1]] == b[f"_{PAGE[1]}"])
    # one join keyed by page; the grouping by token keeps its partitioning
    pairs = t.join(b, same_page & inside(F.col("_cx"), F.col("_cy")), "left")
    agg = F.min_by if pick == "first" else F.max_by
    return pairs.groupBy(*PAGE, "token_id").agg(agg("block_id", "_ord").alias("block_id"))


def nearest(points: DataFrame, known: DataFrame, value: str, limit: float = 50.0) -> DataFrame:
    """``value`` of the nearest known token of the page by city-block distance of centres.

    Ties go to the lower ``token_id``; beyond ``limit`` the value is empty; a page without any known token
    gives no rows. Tokens meet only those of their own and the neighbouring cells of the page, whose side
    is ``limit``.
    """
    def cell(c: str) -> Column:
        return F.floor(F.col(c) / limit)

    k = known.select(*PAGE, F.col("token_id").alias("_k"), centre("x").alias("_kx"), centre("y").alias("_ky"), F.col(value).alias("_v"))
    p = points.select(*PAGE, "token_id", centre("x").alias("_px"), centre("y").alias("_py"))
    around = F.explode(F.array(*[F.struct((cell("_px") + i).alias("cx"), (cell("_py") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    near = p.withColumn("_c", around).select(*PAGE, "token_id", "_px", "_py", F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"))
    distance = F.abs(F.col("_px") - F.col("_kx")) + F.abs(F.col("_py") - F.col("_ky"))
    pairs = near.join(k.withColumn("_cx", cell("_kx")).withColumn("_cy", cell("_ky")), [*PAGE, "_cx", "_cy"]).where(distance <= limit)
    best = pairs.groupBy(*PAGE, "token_id").agg(F.min(F.struct(distance.alias("d"), F.col("_k"), F.col("_v"))).alias("_m"))
    out = p.select(*PAGE, "token_id").join(k.select(*PAGE).distinct(), PAGE, "left_semi").join(best, [*PAGE, "token_id"], "left")
    return out.select(*PAGE, "token_id", F.when(F.col("_m").isNull(), "").otherwise(F.col("_m._v")).alias(value))


def rows(tokens: DataFrame) -> DataFrame:
    """Tokens with ``row_id``: a row breaks where a token isn't level with its predecessor in the page."""
    w = Window.partitionBy(*PAGE).orderBy("token_id")
    top = F.round(F.col("y1") / F.col("ph"), 9)
    t = tokens.withColumn("_top", top).withColumn("_last", F.lag("_top").over(w))
    broken = F.when(same_row(F.col("_top"), F.col("_last")), 0).otherwise(1)
    return t.withColumn("_break", broken).withColumn("row_id", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_top", "_last", "_break")


def row_boxes(clustered: DataFrame) -> DataFrame:
    """Text and union box of each row."""
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_id", F.coalesce("text", F.lit("")).alias("text")))), lambda t: t["text"]), " ")
    return clustered.groupBy(*PAGE, "row_id").agg(words.alias("text"), *union_box())


def reading_order(boxes: DataFrame, key: str = "block_id") -> DataFrame:
    """Rank of a page's boxes by column (twentieths of the page's width), then from top to bottom."""
    w = Window.partitionBy("record_id").orderBy("page_pos", F.floor(F.col("left") / 0.05), "top", key)
    return boxes.withColumn("reading_pos", F.row_number().over(w) - 1)


def reading_order_compat(boxes: DataFrame, key: str = "block_id") -> DataFrame:
    """Order by the pairwise rule: page, then left unless it differs by less than 0.05, then top.

    The rule isn't transitive, so no sort key expresses it; a record's boxes, which are bounded, are sorted
    with it after a sort by ``key``.
    """

    def before(a: tuple, b: tuple) -> int:
        if a[0] != b[0]:
            return -1 if a[0] < b[0] else 1
        k = 2 if abs(a[1] - b[1]) < 0.05 else 1
        return -1 if a[k] < b[k] else 1

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page_pos", key], kind="stable").reset_index(drop=True)
        items = sorted(zip(pdf["page_pos"], pdf["left"], pdf["top"], range(len(pdf)), strict=True), key=cmp_to_key(before))
        pdf["reading_pos"] = 0
        for pos, item in enumerate(items):
            pdf.loc[item[3], "reading_pos"] = pos
        return pdf[["record_id", "page_pos", key, "reading_pos"]]

    rows_ = boxes.select("record_id", "page_pos", "left", "top", key).where("left IS NOT NULL AND top IS NOT NULL")
    return rows_.groupBy("record_id").applyInPandas(order, f"record_id long, page_pos int, {key} int, reading_pos long")
