"""File sources: every reader has a fixed schema and gives the canonical shape in one scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.operators.nested import PAGE

PAGES = T.ArrayType(PAGE)
PAPERS = "metadata struct<paper_id string, authors array<string>, title string, mag_field_of_study array<string>, abstract string, year int, arxiv_id string>, pdf_parse struct<body_text array<struct<section string, text string>>>"
SSC = "paper_id string, abstract_id long, sentences array<string>, labels array<string>, confs array<double>, highlight_scores array<double>, abstract_scores array<double>"
SSC_RESULT = "map<string, array<struct<sentence string, label string, prob double>>>"
SECTIONS = "type string, sections array<struct<header string, body string>>"
COCO = (
    "papers array<struct<id int, paper_sha string, pages int>>, images array<struct<id int, file_name string, height int, width int, paper_id int, page_number int>>,"
    " annotations array<struct<id int, bbox array<double>, image_id int, category_id int, area double, iscrowd boolean>>, categories array<struct<id int, name string, supercategory string>>")
GROUPED = (
    "data array<struct<words array<string>, bbox array<array<int>>, labels array<int>, block_ids array<int>, line_ids array<int>, fonts array<string>>>,"
    " labels map<string, string>, files array<string>, problematic_items array<int>, label_counts map<string, long>")
TSV_COLUMNS = "text string, x_1 int, y_1 int, x_2 int, y_2 int, R int, G int, B int, font string, type string"
TABLE_V1 = "id long, x_1 double, y_1 double, x_2 double, y_2 double, text string, category string, parent int, confidence double, is_block boolean"
TABLE_V2 = "id long, x_1 double, y_1 double, x_2 double, y_2 double, text string, category string, block_id int, line_id int, is_block boolean, is_line boolean"


def _name(suffix: str) -> F.Column:
    """File name without folder and suffix; the suffix is removed as a whole."""
    return F.regexp_replace(F.regexp_extract(F.input_file_name(), r"[^/]+$", 0), suffix.replace(".", r"\.") + "$", "")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its name and its text."""
    return spark.read.text(path, wholetext=True).withColumn("doc_id", _name(".json"))


def layout_json(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, pages)`` of page-array files; a file that holds ``null`` has no pages."""
    return _whole(spark, path).select("doc_id", F.from_json("value", PAGES).alias("pages"))


def layout_blocks(layouts: DataFrame, *kinds: str) -> DataFrame:
    """Blocks of the wanted types from one parse; boxes as shares of the page; order is type, page, place."""
    p = layouts.select("doc_id", F.posexplode("pages").alias("page_pos", "p")).where("p IS NOT NULL")
    b = p.select("doc_id", "page_pos", "p.width", "p.height", F.posexplode("p.layout.bundles").alias("block_id", "b")).where(F.col("b.type").isin(*kinds) if kinds else F.lit(True))
    box = [(F.get("b.bbox", k) / F.col("width" if k % 2 == 0 else "height")).alias(n) for k, n in enumerate(("left", "top", "right", "bottom"))]
    words = F.array_join(F.transform("b.tokens", lambda t: t["text"]), " ")
    order = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("b.type")).cast("int") if kinds else F.lit(0)
    return b.select("doc_id", "page_pos", "block_id", "b.type", *box, words.alias("text"), order.alias("type_order"))


def token_json(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, page_pos, token_id, text, x, y, width, height, font)`` of ``[{page, tokens}]`` files; ids are places."""
    schema = "array<struct<page struct<width double, height double, index int>, tokens array<struct<text string, x double, y double, width double, height double, font string>>>>"
    p = _whole(spark, path).select("doc_id", F.posexplode(F.from_json("value", schema)).alias("page_pos", "p"))
    return p.select("doc_id", "page_pos", F.posexplode("p.tokens").alias("token_id", "t")).select("doc_id", "page_pos", "token_id", "t.*")


def paper_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``(paper_id, year, arxiv_id, title, section_pos, section, text)`` of line-delimited papers."""
    rows = spark.read.schema(PAPERS).json(path)
    return rows.select("metadata.paper_id", "metadata.year", "metadata.arxiv_id", "metadata.title", F.posexplode_outer("pdf_parse.body_text").alias("section_pos", "b")).select(
        "paper_id", "year", "arxiv_id", "title", "section_pos", "b.section", "b.text")


def with_year(papers: DataFrame, year: int | None = None) -> DataFrame:
    """Papers with a year and an archive id, both non-empty."""
    rows = papers.where("year IS NOT NULL AND year <> 0 AND arxiv_id IS NOT NULL AND arxiv_id <> ''")
    return rows if year is None else rows.where(F.col("year") == year)


def paper_xml(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, title, abstract, sections)`` of paper XML; a section is ``(title, sentences)``."""
    sentence = T.ArrayType(T.StringType())
    section = T.StructType([T.StructField("_title", T.StringType()), T.StructField("S", sentence)])
    schema = T.StructType([T.StructField("S", T.StringType()), T.StructField("ABSTRACT", T.StructType([T.StructField("S", sentence)])), T.StructField("SECTION", T.ArrayType(section))])
    rows = spark.read.format("xml").schema(schema).option("rowTag", "PAPER").load(path)
    return rows.select(_name(".xml").alias("doc_id"), F.col("S").alias("title"), F.col("ABSTRACT.S").alias("abstract"),
                       F.transform("SECTION", lambda s: F.struct(s["_title"].alias("title"), s["S"].alias("sentences"))).alias("sections"))


def paper_xml_sentences(papers: DataFrame) -> DataFrame:
    """All section sentences of a paper in order, without the abstract."""
    return papers.select(F.col("doc_id").alias("paper_id"), F.flatten(F.transform("sections", lambda s: s["sentences"])).alias("sentences"))


def ssc_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SSC).json(path)


def ssc_results(spark: SparkSession, path: str) -> DataFrame:
    """``(paper_id, pos, sentence, label, prob)`` of result files, maps from paper to predictions."""
    rows = _whole(spark, path).select(F.explode(F.from_json("value", SSC_RESULT)).alias("paper_id", "preds"))
    return rows.select("paper_id", F.posexplode("preds").alias("pos", "p")).select("paper_id", "pos", "p.*")


def section_dump(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(SECTIONS).option("multiLine", True).json(path).withColumn("doc_id", _name(".json"))
    return rows.select("doc_id", F.posexplode("sections").alias("pos", "s")).select("doc_id", "pos", "s.header", "s.body")


def coco(spark: SparkSession, path: str, pad: float = 0.0, names: dict[str, str] | None = None) -> DataFrame:
    """Annotations with page, corners padded on each side, and category; names mapped where ``names`` is given.

    Unmapped names become null. Pages without image have no annotations and give no rows.
    """
    rows = spark.read.schema(COCO).option("multiLine", True).json(path)
    a = rows.select(F.explode("annotations").alias("a")).select("a.id", "a.image_id", "a.category_id", "a.bbox", "a.area")
    i = rows.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name", "i.page_number", "i.paper_id", "i.width", "i.height")
    c = rows.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    x, y, w, h = (F.get("bbox", k) for k in range(4))
    out = i.join(a, "image_id", "left").join(c, "category_id", "left")
    if names is not None:
        table = F.create_map(*[z for k, v in names.items() for z in (F.lit(k), F.lit(v))]) if names else F.lit(None).cast("map<string,string>")
        out = out.withColumn("category", F.try_element_at(table, "category"))
    return out.select("id", "image_id", "paper_id", "page_number", "file_name", "category", "area",
                      (x - pad).alias("x1"), (y - pad).alias("y1"), (x + w + pad).alias("x2"), (y + h + pad).alias("y2"))


def image_info(images: DataFrame) -> DataFrame:
    """``(id, filename, index, width, height)`` from names such as ``name_3.jpg``."""
    parts = F.regexp_extract("file_name", r"^(.*)_(\d+)\.\w+$", 1), F.regexp_extract("file_name", r"^(.*)_(\d+)\.\w+$", 2)
    return images.select("id", parts[0].alias("filename"), parts[1].cast("int").alias("index"), "width", "height")


def token_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Token files without header or quoting; ``id`` is the line number, drawing marks are left out."""
    rows = spark.read.text(path, wholetext=True).select(_name(".txt").alias("doc_id"), F.posexplode(F.split("value", r"\r?\n")).alias("id", "line")).where("line <> ''")
    names = [c.split() for c in TSV_COLUMNS.split(", ")]
    f = F.split("line", "\t")
    cells = [F.get(f, k).cast(t).alias(n) for k, (n, t) in enumerate(names)]
    return rows.select("doc_id", "id", *cells).where("text NOT IN ('##LTLine##', '##LTFigure##')")


def token_csv(spark: SparkSession, path: str, version: int = 2, font: bool = False) -> DataFrame:
    schema = {1: TABLE_V1, 2: TABLE_V2}[version]
    return spark.read.schema(schema + (", font string" if font else "")).csv(path, header=True)


def grouped_json(spark: SparkSession, path: str) -> DataFrame:
    """``(item, words, bbox, ...)`` of grouped files without the items listed as problematic, by raw index."""
    rows = spark.read.schema(GROUPED).option("multiLine", True).json(path)
    items = rows.select(F.posexplode("data").alias("item", "d")).select("item", "d.*")
    bad = rows.select(F.explode("problematic_items").alias("item")).distinct()
    return items.join(bad, "item", "left_anti")


_CORNERS = "Vertex array<struct<_x double, _y double>>"
_VALUE = "struct<_Value string>"
_WORD = f"struct<WordCorners struct<{_CORNERS}>, GT_Text {_VALUE}, Character array<struct<Font struct<_Type string>, GT_Text {_VALUE}>>>"
_LINE = f"struct<LineCorners struct<{_CORNERS}>, Word array<{_WORD}>>"
_ZONE = f"struct<ZoneCorners struct<{_CORNERS}>, Classification struct<Category {_VALUE}>, Line array<{_LINE}>>"
PAGE_XML = f"Zone array<{_ZONE}>"


def page_xml(spark: SparkSession, path: str) -> DataFrame:
    """Words of zone-line-word XML: one row per word with running ids in its page.

    Corners are the extremes of all vertices, null ones left out; a word's font is the most common of its
    characters, the first of equals; a word without corners stays without box.
    """
    schema = T.StructType.fromDDL(PAGE_XML) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(PAGE_XML)
    pages = spark.read.format("xml").schema(schema).option("rowTag", "Page").load(path).select(_name(".cxml").alias("doc_id"), F.monotonically_increasing_id().alias("page_no"), "Zone")
    w = Window.partitionBy("doc_id").orderBy("page_no")
    pages = pages.withColumn("page_pos", F.dense_rank().over(w) - 1)
    z = pages.select("doc_id", "page_pos", F.posexplode("Zone").alias("block_id", "z"))
    li = z.select("doc_id", "page_pos", "block_id", F.col("z.Classification.Category._Value").alias("category"), F.posexplode("z.Line").alias("_l", "l"))
    wo = li.select("doc_id", "page_pos", "block_id", "category", "_l", F.posexplode("l.Word").alias("_w", "w"))
    v = F.col("w.WordCorners.Vertex")
    xs, ys = F.filter(F.transform(v, lambda p: p["_x"]), lambda x: x.isNotNull()), F.filter(F.transform(v, lambda p: p["_y"]), lambda x: x.isNotNull())
    text = F.coalesce(F.col("w.GT_Text._Value"), F.array_join(F.transform("w.Character", lambda c: c["GT_Text"]["_Value"]), ""))
    fonts = F.filter(F.transform("w.Character", lambda c: c["Font"]["_Type"]), lambda f: f.isNotNull())
    votes = F.transform(F.array_distinct(fonts), lambda f: F.struct(F.size(F.filter(fonts, lambda g: g == f)).alias("n"), (-F.array_position(fonts, f)).alias("at"), f.alias("f")))
    page = Window.partitionBy("doc_id", "page_pos").orderBy("block_id", "_l", "_w")
    return wo.select(
        "doc_id", "page_pos", "block_id", "category", F.dense_rank().over(Window.partitionBy("doc_id", "page_pos").orderBy("block_id", "_l")).alias("line_id"), F.row_number().over(page).alias("id"),
        text.alias("text"), F.array_min(xs).alias("x_1"), F.array_min(ys).alias("y_1"), F.array_max(xs).alias("x_2"), F.array_max(ys).alias("y_2"), F.array_max(votes)["f"].alias("font"),
    ).withColumns({"id": F.col("id") - 1, "line_id": F.col("line_id") - 1})


def font_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(font, font_id)`` of a list of names: ids follow the order of the lines after the five special ones."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("k", "font")).where("font <> ''")
    return lines.select("font", (F.col("k") + 5).alias("font_id"))


def binary_pages(spark: SparkSession, path: str, extract: Callable, schema: str) -> DataFrame:
    """Pages or tokens of binary files by a pluggable extractor over batches of ``(path, content)``."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(extract, schema)


EXTRACTORS: dict[str, Callable] = {}


def register_extractor(name: str, extract: Callable) -> None:
    EXTRACTORS[name.lower()] = extract


def extractor(name: str) -> Callable:
    """A registered extractor by its name in any letter case."""
    try:
        return EXTRACTORS[name.lower()]
    except KeyError:
        raise NotImplementedError(f"no extractor named {name!r}") from None


def words_from_chars(chars: DataFrame, page_height: str = "page_height") -> DataFrame:
    """Words from a stream of characters that breaks at blank ones; the vertical axis is turned over.

    ``(doc_id, page_pos, k, text, x1, y1, x2, y2, page_height)`` to one row per word with its union box.
    """
    w = Window.partitionBy("doc_id", "page_pos").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    blank = F.col("text").isNull() | F.col("text").rlike(r"^\s*$")
    c = chars.withColumn("_g", F.sum(F.when(blank, 1).otherwise(0)).over(w)).where(~blank)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda s: s["text"]), "")
    g = c.groupBy("doc_id", "page_pos", "_g").agg(F.min("k").alias("k"), text.alias("text"), F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y1").alias("_lo"), F.max("y2").alias("_hi"), F.first(page_height).alias("_h"))
    return g.select("doc_id", "page_pos", "k", "text", "x1", (F.col("_h") - F.col("_hi")).alias("y1"), "x2", (F.col("_h") - F.col("_lo")).alias("y2"))


def page_sizes_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("savename string, page_id int, height double, width double").csv(path, header=True)


def table_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated sample with a header line."""
    return spark.read.schema(schema).csv(path, header=True, sep="\t")


def first_available(candidates: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``value`` of the first source, by ``order``, that has one for each key; null where none has."""
    got = candidates.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))
    return candidates.select(key).distinct().join(got, key, "left")
