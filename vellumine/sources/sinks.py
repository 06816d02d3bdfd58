"""File sinks: shapes that readers of the written files expect; no sink gathers data in the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.operators.geometry import PAGE


def facet_json(facets: DataFrame, path: str, key: str = "paper_id") -> None:
    """A folder per document with its facets as JSON lines."""
    facets.write.mode("overwrite").partitionBy(key).json(path)


def documents_json(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``(key, json)``: one JSON array per document in order, for writers of one file a document."""
    items = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"_{k}") for k, o in enumerate(order)], F.struct(*items).alias("v")))), lambda s: s["v"])).alias(name))


def ssc_jsonl(rows: DataFrame, path: str) -> None:
    """``{paper_id, sentences}`` lines."""
    rows.select("paper_id", "sentences").write.mode("overwrite").json(path)


def ssc_results(preds: DataFrame) -> DataFrame:
    """``(paper_id, json)`` with a map from the paper to its predictions in order."""
    p = preds.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct("sentence", "label", "prob").alias("v")))), lambda s: s["v"]).alias("v"))
    return p.select("paper_id", F.to_json(F.map_from_entries(F.array(F.struct("paper_id", "v")))).alias("json"))


def paper_json(papers: DataFrame) -> DataFrame:
    """``{id, title, body}`` with the sections as a map."""
    body = F.map_from_entries(F.transform("sections", lambda s: F.struct(s["title"], s["sentences"])))
    return papers.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), "title", body.alias("body"))).alias("json"))


def token_csv(table: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Token tables; fonts are written as they are, cleaned only in the grouped form; no parent is -1."""
    out = table.withColumn("parent", F.coalesce("parent", F.lit(-1))) if "parent" in table.columns else table
    w = out.write.mode("overwrite").option("header", True)
    (w.partitionBy(*partition) if partition else w).csv(path)


def page_sizes_csv(pages: DataFrame, path: str) -> None:
    pages.select("savename", "page_id", "height", "width").write.mode("overwrite").option("header", True).csv(path)


def grouped_json(items: DataFrame, labels: dict[str, int]) -> DataFrame:
    """One JSON object per subset: data, label names by id and label counts. For subsets that fit one file."""
    names = F.create_map(*[x for k, i in labels.items() for x in (F.lit(str(i)), F.lit(k))])
    return items.groupBy("subset").agg(F.to_json(F.struct(F.collect_list(F.struct("words", "bbox", "labels", "block_ids")).alias("data"), names.alias("labels"))).alias("json"))


def coco_json(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three lists of an annotation file; boxes as x, y, width, height with their area."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    a = annotations.select("id", "image_id", "category_id", F.array("x1", "y1", w, h).alias("bbox"), (w * h).alias("area"), F.lit(0).alias("iscrowd"))
    return images.select("id", "file_name", "height", "width", "paper_id", "page_number"), a, categories.select("id", "name", F.lit(None).cast("string").alias("supercategory"))


def layout_json(layouts: DataFrame, path: str) -> None:
    layouts.write.mode("overwrite").json(path)


def block_lists_json(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``(record_id, json)``: pages with blocks as ``[x, y, width, height, Type]``."""
    cell: Column = F.array(F.col("x1").cast("string"), F.col("y1").cast("string"), (F.col("x2") - F.col("x1")).cast("string"), (F.col("y2") - F.col("y1")).cast("string"), F.initcap("type"))
    b = blocks.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("block_id", cell.alias("c")))), lambda s: s["c"]).alias("blocks"))
    p = pages.join(b, PAGE, "left").select(*PAGE, F.struct(F.struct("height", "width", F.col("page_pos").alias("index")).alias("page"), F.coalesce("blocks", F.array().cast("array<array<string>>")).alias("blocks")).alias("v"))
    return p.groupBy("record_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("page_pos", "v"))), lambda s: s["v"])).alias("json"))


def metrics_json(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.to_json(F.struct("*")).alias("json"))


# Codes of what failed (fixed values).
ERRORS = {1: "page count differs", 2: "tokens missing", 3: "file unreadable", 4: "layout missing", 5: "write failed"}


def dead_letters(failed: DataFrame, path: str) -> None:
    """Append ``(error_type, pdf_name)`` rows to the error table."""
    failed.select("error_type", "pdf_name").write.mode("append").option("header", True).csv(path)


def manifest_csv(rows: DataFrame, path: str) -> None:
    """Append what a run fetched or processed to its manifest."""
    rows.write.mode("append").option("header", True).csv(path)


def font_vocabulary(fonts: DataFrame, path: str) -> None:
    fonts.select("font").write.mode("overwrite").text(path)


def only_missing(files: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs without output yet."""
    return files.join(done.select(key).distinct(), key, "left_anti")
