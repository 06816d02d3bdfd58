"""Layout tables: conversion between nested and flat forms, votes and label maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import clean_font
from vellumine.operators.geometry import PAGE

# Label ids (fixed values).
LABELS = {
    "paragraph": 0, "title": 1, "equation": 2, "reference": 3, "section": 4, "list": 5, "table": 6, "caption": 7, "author": 8, "abstract": 9,
    "footer": 10, "date": 11, "figure": 12,
}
# Display colours of block types (fixed values).
COLOURS = {
    None: "#C0C0C0", "abstract": "#ffb6c1", "author": "#02028b", "caption": "#00ff03", "date": "#0f0000", "equation": "#ff0000", "figure": "#ff01ff",
    "footer": "#C2C2C2", "list": "#302070", "paragraph": "#b0c4de", "text": "#b0c4de", "reference": "#309000", "section": "#0603ff", "table": "#01ffff",
    "title": "#00bfff",
}
TEXTUAL = ("text", "title", "list")
MOST_BLOCKS = 32
FONT_SPECIALS = 5


def to_table(blocks: DataFrame, tokens: DataFrame) -> DataFrame:
    """Flat table of a layout: block rows with parent -1, then token rows."""
    b = blocks.select(*PAGE, F.col("block_id").cast("long").alias("id"), F.lit(None).cast("string").alias("text"), F.col("type").alias("category"),
                      F.lit(-1).alias("parent"), "confidence", F.lit(True).alias("is_block"))
    t = tokens.select(*PAGE, F.col("token_id").cast("long").alias("id"), "text", F.col("type").alias("category"), "parent", "confidence", F.lit(False).alias("is_block"))
    return b.unionByName(t)


def from_table(flat: DataFrame) -> DataFrame:
    """Nested form of the flat table: bundles with their tokens, and the remaining tokens, by page."""
    token = F.struct("id", "text", "category", "confidence")
    t = flat.where("NOT is_block")
    own = t.where("parent IS NOT NULL").groupBy(*PAGE, "parent").agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    rest = t.where("parent IS NULL").groupBy(*PAGE).agg(F.array_sort(F.collect_list(token)).alias("remaining_tokens"))
    b = flat.where("is_block").select(*PAGE, F.col("id").cast("int").alias("parent"), F.col("category").alias("type"), F.col("confidence").alias("score")).join(own, [*PAGE, "parent"], "left")
    bundles = b.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("parent", "type", "score", "tokens"))).alias("bundles"))
    return bundles.join(rest, PAGE, "full")


def modal(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most common value of each group; of equals the one met first."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", (-F.col("first")).alias("f"))).alias(value))


def _ordered(value: Column, key: str = "token_id") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(key), value.alias("v")))), lambda s: s["v"])


def page_arrays(tokens: DataFrame) -> DataFrame:
    """Parallel arrays of a page's words, boxes, labels and blocks in token order."""
    return tokens.groupBy(*PAGE).agg(
        _ordered(F.coalesce("text", F.lit(""))).alias("words"), _ordered(F.array("x1", "y1", "x2", "y2")).alias("bbox"),
        _ordered(F.coalesce("type", F.lit(""))).alias("labels"), _ordered(F.coalesce("parent", F.lit(-1))).alias("block_ids"))


def segments(tokens: DataFrame) -> DataFrame:
    """One row per parent: words and boxes in order, category of the first token."""
    return tokens.where("parent IS NOT NULL").groupBy(*PAGE, "parent").agg(
        _ordered(F.coalesce("text", F.lit(""))).alias("words"), _ordered(F.array("x1", "y1", "x2", "y2")).alias("bbox"),
        F.min_by(F.coalesce("type", F.lit("")), "token_id").alias("category"))


def block_text(blocks: DataFrame, tokens: DataFrame) -> DataFrame:
    t = tokens.where("parent IS NOT NULL").groupBy(*PAGE, F.col("parent").alias("block_id")).agg(F.array_join(_ordered(F.coalesce("text", F.lit(""))), " ").alias("text"))
    return blocks.select(*PAGE, "block_id").join(t, [*PAGE, "block_id"])


def inherit(blocks: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens with the type of their block; unassigned ones keep their own."""
    b = blocks.select(*PAGE, F.col("block_id").alias("parent"), F.col("type").alias("_type"), F.lit(True).alias("_hit"))
    return tokens.join(b, [*PAGE, "parent"], "left").withColumn("type", F.when(F.col("_hit"), F.col("_type")).otherwise(F.col("type"))).drop("_type", "_hit")


def _retype(blocks: DataFrame, votes: DataFrame) -> DataFrame:
    v = votes.select(*PAGE, F.col("parent").alias("block_id"), F.col("type").alias("_vote"))
    textual = F.col("type").isin(*TEXTUAL)
    return blocks.join(v, [*PAGE, "block_id"], "left").select(*PAGE, "block_id", F.when(textual, F.col("_vote")).otherwise(F.col("type")).alias("type"))


def vote_textual(blocks: DataFrame, tokens: DataFrame) -> DataFrame:
    """Textual blocks take the most common type of their tokens."""
    return _retype(blocks, modal(tokens.where("parent IS NOT NULL AND type IS NOT NULL"), [*PAGE, "parent"], "type", "token_id"))


def first_textual(blocks: DataFrame, tokens: DataFrame) -> DataFrame:
    """Textual blocks take the type of their first token."""
    return _retype(blocks, tokens.where("parent IS NOT NULL").groupBy(*PAGE, "parent").agg(F.min_by(F.struct("type"), "token_id").alias("t")).select(*PAGE, "parent", "t.type"))


def clamp_block(parent: Column) -> Column:
    return F.coalesce(F.least(parent + 1, F.lit(MOST_BLOCKS)), F.lit(0))


def label_id(category: Column) -> Column:
    """Id of a label, null if unknown."""
    table = F.create_map(*[x for k, i in LABELS.items() for x in (F.lit(k), F.lit(i))])
    return F.try_element_at(table, category)


def font_id(font: Column, vocabulary: list[str]) -> Column:
    """Id of a font: 0 for null, 1 for unknown, then the place in the vocabulary after the special ids."""
    table = F.create_map(*[x for k, f in enumerate(vocabulary) for x in (F.lit(f), F.lit(FONT_SPECIALS + k))])
    return F.when(font.isNull(), 0).otherwise(F.coalesce(F.try_element_at(table, clean_font(font)), F.lit(1)))


def font_vocabulary(fonts: DataFrame, more_than: int) -> DataFrame:
    return fonts.select(clean_font(F.col("font")).alias("font")).groupBy("font").agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def problematic(rows: DataFrame, column: str) -> DataFrame:
    """Items that are empty or hold nulls."""
    return rows.where((F.size(column) == 0) | F.exists(column, lambda x: x.isNull()))


def levels(blocks: DataFrame, clustered: DataFrame) -> DataFrame:
    """Three-level table of a page: blocks, lines and words with ``block_id``, ``line_id`` and level flags.

    ``clustered`` are tokens with ``row_id``; a line is a row within a block, -1 stands for no parent.
    """
    parent = F.coalesce("parent", F.lit(-1))
    b = blocks.select(*PAGE, F.col("block_id").cast("long").alias("id"), "x1", "y1", "x2", "y2", F.lit(None).cast("string").alias("text"), F.col("type").alias("category"),
                      F.lit(-1).alias("block_id"), F.lit(-1).cast("long").alias("line_id"), F.lit(True).alias("is_block"), F.lit(False).alias("is_line"))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_id", F.coalesce("text", F.lit("")).alias("t")))), lambda s: s["t"]), " ")
    line = clustered.groupBy(*PAGE, parent.alias("block_id"), F.col("row_id").cast("long").alias("id")).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), words.alias("text"), F.min_by("type", "token_id").alias("category"))
    li = line.select(*PAGE, "id", "x1", "y1", "x2", "y2", "text", "category", "block_id", F.lit(-1).cast("long").alias("line_id"), F.lit(False).alias("is_block"), F.lit(True).alias("is_line"))
    w = clustered.select(*PAGE, F.col("token_id").cast("long").alias("id"), "x1", "y1", "x2", "y2", "text", F.col("type").alias("category"), parent.alias("block_id"),
                         F.col("row_id").cast("long").alias("line_id"), F.lit(False).alias("is_block"), F.lit(False).alias("is_line"))
    return b.unionByName(li).unionByName(w)


def words_of(table: DataFrame) -> DataFrame:
    return table.where("NOT is_block AND NOT is_line")


def with_line_parent(table: DataFrame) -> DataFrame:
    """Words whose block comes from their line."""
    lines = table.where("is_line").select(*PAGE, F.col("id").alias("line_id"), F.col("block_id").alias("line_block")).dropDuplicates([*PAGE, "line_id", "line_block"])
    first = lines.groupBy(*PAGE, "line_id").agg(F.min("line_block").alias("line_block"))
    return words_of(table).join(first, [*PAGE, "line_id"], "left")


def page_json(table: DataFrame) -> DataFrame:
    """``(page, layout)``: the three levels as one JSON object of blocks, lines and tokens."""
    item = F.struct("id", F.array("x1", "y1", "x2", "y2").alias("bbox"), F.col("category").alias("type"), "text", F.col("line_id").alias("parent_line_id"), F.col("block_id").alias("parent_block_id"))

    def level(condition: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.expr(condition), item)))

    return table.groupBy(*PAGE).agg(F.to_json(F.struct(level("is_block").alias("blocks"), level("is_line").alias("lines"), level("NOT is_block AND NOT is_line").alias("tokens"))).alias("layout"))


def bundles_from_levels(table: DataFrame) -> DataFrame:
    """Blocks with their words, the bundle form of the three-level table."""
    b = table.where("is_block").select(*PAGE, F.col("id").cast("int").alias("block_id"), F.col("category").alias("type"), "x1", "y1", "x2", "y2")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("text", F.lit("")).alias("t")))), lambda s: s["t"]), " ")
    return b.join(words_of(table).groupBy(*PAGE, "block_id").agg(text.alias("text")), [*PAGE, "block_id"], "left")


def mask_pixels(tokens: DataFrame, cell: float = 4.0) -> DataFrame:
    """``(page, px, py, type)``: raster cells painted with token types; the later token wins."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell).cast("int"), F.floor(F.col(b) / cell).cast("int")))
    t = tokens.where("x2 >= x1 AND y2 >= y1 AND type IS NOT NULL").select(*PAGE, "token_id", "type", "y1", "y2", span("x1", "x2").alias("px"))
    return t.select(*PAGE, "token_id", "type", "px", span("y1", "y2").alias("py")).groupBy(*PAGE, "px", "py").agg(F.max_by("type", "token_id").alias("type"))


def near_words(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(word, near)``: different words of two vocabularies within one edit.

    Words within one edit share the word itself or the word less one character, so both sides meet on these
    keys instead of each with all; the distance then decides.
    """
    def keyed(words: DataFrame, name: str) -> DataFrame:
        n = F.char_length("word")
        short = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, n)))
        return words.where(n > 0).withColumn("_key", F.explode(F.array_distinct(F.concat(F.array("word"), short)))).withColumnRenamed("word", name)

    pairs = keyed(a, "word").join(keyed(b, "near"), "_key").where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near") <= 1))
    return pairs.select("word", "near").distinct()


def coco_tables(pages: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of an annotation set, from pages and their typed blocks."""
    number = F.col("record_id") * 1000 + F.col("page_pos")
    images = pages.select(number.alias("image_id"), F.concat_ws("", F.col("record_id").cast("string"), F.lit("_"), F.col("page_pos").cast("string"), F.lit(".jpg")).alias("file_name"), "width", "height")
    names = blocks.where("type IS NOT NULL").select(F.col("type").alias("name")).distinct()
    # a handful of categories: the window is as small as their list
    categories = names.withColumn("category_id", F.row_number().over(Window.orderBy("name")))
    rows = blocks.join(F.broadcast(categories), blocks["type"] == categories["name"])
    annotations = rows.select(number.alias("image_id"), "block_id", "category_id", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    return images, annotations, categories


def coco_blocks(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations with the file and size of their image and the name of their category."""
    named = annotations.join(F.broadcast(categories), "category_id")
    return named.join(images, "image_id").select("file_name", "width", "height", F.col("name").alias("category"), "block_id", "x", "y", "w", "h")


def true_blocks_typed(blocks: DataFrame, tokens: DataFrame, skipped: int = 3) -> tuple[DataFrame, DataFrame]:
    """Blocks and tokens where true blocks are typed by a classifier of their tokens.

    ``tokens`` has ``parent`` and the detected ``type``. A figure and its tokens stay a figure; the first
    ``skipped`` tokens of a caption, its label, aren't asked and take the type of the next; a block takes the
    type of its first token. A block without an answer keeps its own type.
    """
    w = Window.partitionBy(*PAGE, "parent").orderBy("token_id")
    own = tokens.where("parent IS NOT NULL").join(blocks.select(*PAGE, F.col("block_id").alias("parent"), F.col("type").alias("_block")), [*PAGE, "parent"])
    own = own.withColumn("_k", F.row_number().over(w) - 1)
    caption = F.col("_block").eqNullSafe(F.lit("caption"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    answer = F.max(F.when(F.col("_k") == skipped, F.col("type"))).over(whole)
    typed = F.when(F.col("_block").eqNullSafe(F.lit("figure")), F.lit("figure")).when(caption & (F.col("_k") < skipped), answer).otherwise(F.col("type"))
    out = own.select(*PAGE, "parent", "token_id", typed.alias("type"))
    first = out.groupBy(*PAGE, "parent").agg(F.min_by(F.struct("type"), "token_id").alias("t")).select(*PAGE, F.col("parent").alias("block_id"), F.col("t.type").alias("_new"))
    return blocks.join(first, [*PAGE, "block_id"], "left").withColumn("type", F.coalesce("_new", "type")).drop("_new"), out
