"""Queries over pages, blocks and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import geometry as g
from vellumine.operators import layout as lo
from vellumine.operators import segment as sg
from vellumine.operators import sequence as sq
from vellumine.plans import sqlviews as v
from vellumine.sources import canonical
from vellumine.sources.tables import table

QUERIES, SQL = {}, {}
P = "record_id, page_pos"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _r(cols: str, n: int = 6) -> str:
    return ", ".join(f"round({c}, {n}) AS {c}" for c in cols.split())


def _rounded(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


_T = canonical.tokens
_B = canonical.blocks
_BP = "blocks b JOIN pages_v p USING (record_id, page_pos)"


@query(f"{v.LAYOUT} SELECT {P}, width, height, index FROM pages_v")
def pages_table(spark: SparkSession, d: str) -> DataFrame:
    return canonical.pages(spark, d)


@query(f"{v.LAYOUT} SELECT {P}, token_id, parent, text, type, confidence, x1, y1, x2, y2 FROM tokens")
def tokens_table(spark: SparkSession, d: str) -> DataFrame:
    return _T(spark, d).drop("pw", "ph")


def _ratio(spark: SparkSession, d: str) -> DataFrame:
    rows = _B(spark, d).join(canonical.pages(spark, d), g.PAGE)
    return _rounded(rows.select(*g.PAGE, "block_id", "type", *g.ratio_box(F.col("width"), F.col("height"))), "left", "top", "w", "h")


_RATIO = f"SELECT {P}, block_id, type, round(x1 / width, 6) AS left, round(y1 / height, 6) AS top, round((x2 - x1) / width, 6) AS w, round((y2 - y1) / height, 6) AS h FROM {_BP}"


@query(f"{v.LAYOUT} {_RATIO}")
def bbox_normalise(spark: SparkSession, d: str) -> DataFrame:
    return _ratio(spark, d)


@query(f"{v.LAYOUT} SELECT {P}, token_id, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy, x2 - x1 AS w FROM tokens")
def box_centres(spark: SparkSession, d: str) -> DataFrame:
    return _T(spark, d).select(*g.PAGE, "token_id", F.round(g.centre("x"), 6).alias("cx"), F.round(g.centre("y"), 6).alias("cy"), (F.col("x2") - F.col("x1")).alias("w"))


@query(f"{v.LAYOUT} SELECT {P}, block_id, CAST(trunc(x1 * 1000 / width) AS INTEGER) AS x1, CAST(trunc(y1 * 1000 / height) AS INTEGER) AS y1, CAST(trunc(x2 * 1000 / width) AS INTEGER) AS x2, CAST(trunc(y2 * 1000 / height) AS INTEGER) AS y2 FROM {_BP}")
def grid1000(spark: SparkSession, d: str) -> DataFrame:
    return _B(spark, d).join(canonical.pages(spark, d), g.PAGE).select(*g.PAGE, "block_id", *g.grid1000(F.col("width"), F.col("height")))


@query(f"{v.LAYOUT}, s AS (SELECT {P}, token_id, x1 * 1.4 AS x1, y1 * 1.4 AS y1, x2 * 1.4 AS x2, y2 * 1.4 AS y2, pw, ph FROM tokens WHERE pw IS NOT NULL AND ph IS NOT NULL) SELECT {P}, token_id, round(greatest(0, least(x1, trunc(pw))), 6) AS x1, round(greatest(0, least(y1, trunc(ph))), 6) AS y1, round(greatest(0, least(x2, trunc(pw))), 6) AS x2, round(greatest(0, least(y2, trunc(ph))), 6) AS y2 FROM s")
def clip_boxes(spark: SparkSession, d: str) -> DataFrame:
    t = _T(spark, d).where("pw IS NOT NULL AND ph IS NOT NULL").select(*g.PAGE, "token_id", *g.scale(F.lit(1.4), F.lit(1.4)), "pw", "ph")
    return _rounded(t.select(*g.PAGE, "token_id", *g.clip(F.col("pw"), F.col("ph"))), "x1", "y1", "x2", "y2")


@query(f"{v.LAYOUT} SELECT {P}, block_id, round(x1 - 2, 6) AS x1, round(y1 - 2, 6) AS y1, round(x2 + 2, 6) AS x2, round(y2 + 2, 6) AS y2 FROM blocks")
def pad_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_B(spark, d).select(*g.PAGE, "block_id", *g.pad(2.0)), "x1", "y1", "x2", "y2")


@query(f"{v.LAYOUT} SELECT {P}, block_id, round(x1 * (1000 / width), 4) AS x1, round(y1 * (1400 / height), 4) AS y1, round(x2 * (1000 / width), 4) AS x2, round(y2 * (1400 / height), 4) AS y2 FROM {_BP}")
def scale_like(spark: SparkSession, d: str) -> DataFrame:
    rows = _B(spark, d).join(canonical.pages(spark, d), g.PAGE).select(*g.PAGE, "block_id", *g.scale(F.lit(1000) / F.col("width"), F.lit(1400) / F.col("height")))
    return _rounded(rows, "x1", "y1", "x2", "y2", n=4)


@query(f"{v.LAYOUT} SELECT {P}, block_id, x1 AS x, y1 AS y, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h, round((x2 - x1) * (y2 - y1), 4) AS area FROM blocks")
def coco_area(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_rounded(_B(spark, d).select(*g.PAGE, "block_id", *g.xywh()), "w", "h"), "area", n=4)


@query(f"{v.LAYOUT} SELECT {P}, token_id, x1, round(ph - y2, 6) AS y1, x2, round(ph - y1, 6) AS y2 FROM tokens")
def yflip(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_T(spark, d).select(*g.PAGE, "token_id", *g.flip_y(F.col("ph"))), "y1", "y2")


@query(f"{v.LAYOUT} SELECT {P}, token_id FROM tokens WHERE (x1 + x2) / 2 BETWEEN 100 AND 300 AND (y1 + y2) / 2 BETWEEN 200 AND 500")
def filter_tokens_by_box(spark: SparkSession, d: str) -> DataFrame:
    return _T(spark, d).where(g.centre("x").between(100, 300) & g.centre("y").between(200, 500)).select(*g.PAGE, "token_id")


@query(f"{v.LAYOUT}, r AS ({_RATIO}) SELECT {P}, block_id, row_number() OVER (PARTITION BY record_id ORDER BY page_pos, floor(r.left / 0.05), top, block_id) - 1 AS reading_pos FROM r WHERE r.left IS NOT NULL AND top IS NOT NULL")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return g.reading_order(_ratio(spark, d).where("left IS NOT NULL AND top IS NOT NULL")).select(*g.PAGE, "block_id", "reading_pos")


@query()
def reading_order_compat(spark: SparkSession, d: str) -> DataFrame:
    return g.reading_order_compat(_ratio(spark, d))


_ROWS = f"""_r1 AS (SELECT *, round(y1 / ph, 9) AS top, lag(round(y1 / ph, 9)) OVER (PARTITION BY {P} ORDER BY token_id) AS last FROM tokens),
clustered AS (SELECT *, sum(CASE WHEN abs(top - last) < 0.01 THEN 0 ELSE 1 END) OVER (PARTITION BY {P} ORDER BY token_id ROWS UNBOUNDED PRECEDING) - 1 AS row_id FROM _r1)"""


@query(f"{v.LAYOUT}, {_ROWS} SELECT {P}, token_id, CAST(row_id AS BIGINT) AS row_id FROM clustered")
def row_cluster(spark: SparkSession, d: str) -> DataFrame:
    return g.rows(_T(spark, d)).select(*g.PAGE, "token_id", F.col("row_id").cast("long").alias("row_id"))


@query(f"{v.LAYOUT}, {_ROWS} SELECT {P}, CAST(row_id AS BIGINT) AS row_id, string_agg(coalesce(text, ''), ' ' ORDER BY token_id) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM clustered GROUP BY {P}, row_id")
def row_text_bbox(spark: SparkSession, d: str) -> DataFrame:
    return g.row_boxes(g.rows(_T(spark, d))).withColumn("row_id", F.col("row_id").cast("long"))


_HIT = f"""hits AS (SELECT t.record_id, t.page_pos, t.token_id, b.block_id, b.type AS btype, b.confidence AS bconf FROM tokens t JOIN blocks b ON b.record_id = t.record_id AND b.page_pos = t.page_pos
  AND (t.x1 + t.x2) / 2 BETWEEN b.x1 - 1 AND b.x2 + 1 AND (t.y1 + t.y2) / 2 BETWEEN b.y1 - 1 AND b.y2 + 1)"""


def _assigned(fn: str) -> str:
    return f"{v.LAYOUT}, {_HIT} SELECT {P}, token_id, {fn}(h.block_id) AS block_id FROM tokens LEFT JOIN hits h USING ({P}, token_id) GROUP BY {P}, token_id"


@query(_assigned("min"))
def assign_first_match(spark: SparkSession, d: str) -> DataFrame:
    return g.assign(_T(spark, d), _B(spark, d), "first")


@query(_assigned("max"))
def assign_last_match(spark: SparkSession, d: str) -> DataFrame:
    return g.assign(_T(spark, d), _B(spark, d), "last")


@query(f"{v.LAYOUT}, {_HIT}, a AS (SELECT {P}, token_id, min(block_id) AS block_id FROM hits GROUP BY {P}, token_id) SELECT {P}, block_id, count(a.token_id) AS n FROM blocks LEFT JOIN a USING ({P}, block_id) GROUP BY {P}, block_id")
def assign_keep_empty(spark: SparkSession, d: str) -> DataFrame:
    blocks = _B(spark, d)
    got = g.assign(_T(spark, d), blocks).where("block_id IS NOT NULL").groupBy(*g.PAGE, "block_id").agg(F.count("*").alias("n"))
    return blocks.select(*g.PAGE, "block_id").join(got, [*g.PAGE, "block_id"], "left").fillna(0, ["n"])


@query(f"{v.LAYOUT}, {_HIT} SELECT {P}, token_id FROM tokens ANTI JOIN hits USING ({P}, token_id)")
def remaining_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = _T(spark, d)
    return tokens.select(*g.PAGE, "token_id").join(g.matches(tokens, _B(spark, d)), [*g.PAGE, "token_id"], "left_anti")


@query(f"{v.LAYOUT}, {_HIT} SELECT {P}, token_id, arg_min(block_id, (CASE WHEN bconf >= 0.5 THEN 0 ELSE 1 END) * 1000000 + block_id) AS block_id FROM hits GROUP BY {P}, token_id")
def two_detector_cascade(spark: SparkSession, d: str) -> DataFrame:
    ranked = _B(spark, d).withColumn("ord", F.when(F.col("confidence") >= 0.5, 0).otherwise(1) * 1000000 + F.col("block_id"))
    return g.assign(_T(spark, d), ranked, order="ord").where("block_id IS NOT NULL")


@query(f"{v.LAYOUT}, {_HIT} SELECT {P}, token_id, block_id, btype FROM hits")
def label_all_containing(spark: SparkSession, d: str) -> DataFrame:
    return g.matches(_T(spark, d), _B(spark, d)).select(*g.PAGE, "token_id", "block_id", F.col("type").alias("btype"))


@query(f"""{v.LAYOUT}, k AS (SELECT {P}, token_id AS kid, (x1 + x2) / 2 AS kx, (y1 + y2) / 2 AS ky, type FROM tokens WHERE type IS NOT NULL),
n AS (SELECT t.record_id, t.page_pos, t.token_id, abs((t.x1 + t.x2) / 2 - kx) + abs((t.y1 + t.y2) / 2 - ky) AS dist, kid, k.type FROM tokens t JOIN k ON k.record_id = t.record_id AND k.page_pos = t.page_pos WHERE t.type IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY {P}, token_id ORDER BY dist, kid) AS rn FROM n)
SELECT {P}, token_id, CASE WHEN dist > 50 THEN '' ELSE type END AS type FROM r WHERE rn = 1""")
def nearest_font(spark: SparkSession, d: str) -> DataFrame:
    tokens = _T(spark, d)
    return g.nearest(tokens.where("type IS NULL"), tokens.where("type IS NOT NULL"), "type")


_WORDS = """WITH _w AS (SELECT doc_id, regexp_extract_all(text, '[^\\s\\x0b]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(range(len(ws))) AS token_id, unnest(ws) AS token FROM _w),
spans AS (SELECT *, CAST(sum(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY token_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS end_, length(token) AS n FROM words)"""
_SENT = r"""_j AS (SELECT doc_id, regexp_extract_all(array_to_string(ws, ' '), '[^.!?]*[.!?]+|[^.!?]+$') AS ss FROM _w),
_k AS (SELECT doc_id, unnest(range(len(ss))) AS sent_id, unnest(ss) AS s FROM _j),
sspans AS (SELECT doc_id, sent_id, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY sent_id ROWS UNBOUNDED PRECEDING) AS se, length(s) AS n FROM _k)"""


@query(f'{_WORDS} SELECT doc_id, token_id, end_ - n AS start, end_ AS "end" FROM spans')
def token_char_spans(spark: SparkSession, d: str) -> DataFrame:
    return sg.char_spans(table(spark, d, "documents"), "doc_id").select("doc_id", "token_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"{_WORDS}, {_SENT}, c AS (SELECT t.doc_id, t.token_id, s.sent_id, greatest(s.se - s.n - (t.end_ - t.n), 0) + greatest(t.end_ - s.se, 0) AS cost FROM spans t JOIN sspans s ON s.doc_id = t.doc_id AND t.end_ - t.n < s.se AND t.end_ > s.se - s.n) SELECT doc_id, token_id, arg_min(sent_id, cost * 1000000 + sent_id) AS sent_id FROM c GROUP BY 1, 2")
def token_to_sentence(spark: SparkSession, d: str) -> DataFrame:
    return sg.tokens_to_sentences(table(spark, d, "documents"), "doc_id")


@query(f"{_WORDS}, f AS (SELECT doc_id, token_id, token_id - row_number() OVER (PARTITION BY doc_id ORDER BY token_id) AS grp FROM words WHERE length(token) >= 5), i AS (SELECT doc_id, grp, min(token_id) AS start, count(*) AS length FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start) AS rn FROM i) SELECT doc_id, start, length FROM r WHERE rn = 1")
def longest_run(spark: SparkSession, d: str) -> DataFrame:
    return sg.longest_run(sg.words(table(spark, d, "documents"), "doc_id").where("char_length(token) >= 5"), "doc_id", "token_id")


# A row is the run of a page's tokens on one level; a row box joins a parent's tokens of one row.
@query(f"{v.LAYOUT}, {_ROWS} SELECT {P}, parent, CAST(row_id AS BIGINT) AS row_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM clustered WHERE parent IS NOT NULL GROUP BY {P}, parent, row_id")
def block_row_bboxes(spark: SparkSession, d: str) -> DataFrame:
    t = g.rows(_T(spark, d)).where("parent IS NOT NULL")
    return t.groupBy(*g.PAGE, "parent", F.col("row_id").cast("long").alias("row_id")).agg(*g.union_box())


@query(f"""{v.LAYOUT}, {_ROWS}, words AS (SELECT *, CAST(sum(length(text) + 1) OVER (PARTITION BY {P} ORDER BY token_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS e, length(text) AS n FROM clustered WHERE text IS NOT NULL AND text <> ''),
j AS (SELECT {P}, regexp_extract_all(string_agg(text, ' ' ORDER BY token_id), '[^.!?]*[.!?]+|[^.!?]+$') AS ss FROM words GROUP BY {P}),
k AS (SELECT {P}, unnest(range(len(ss))) AS sent_id, unnest(ss) AS s FROM j),
q AS (SELECT {P}, sent_id, sum(length(s)) OVER (PARTITION BY {P} ORDER BY sent_id ROWS UNBOUNDED PRECEDING) AS se, length(s) AS sn FROM k),
c AS (SELECT t.record_id, t.page_pos, t.token_id, q.sent_id, greatest(q.se - q.sn - (t.e - t.n), 0) + greatest(t.e - q.se, 0) AS cost FROM words t JOIN q ON q.record_id = t.record_id AND q.page_pos = t.page_pos AND t.e - t.n < q.se AND t.e > q.se - q.sn),
a AS (SELECT {P}, token_id, arg_min(sent_id, cost * 1000000 + sent_id) AS sent_id FROM c GROUP BY ALL)
SELECT {P}, CAST(sent_id AS INTEGER) AS sent_id, CAST(row_id AS BIGINT) AS row_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM words JOIN a USING (record_id, page_pos, token_id) GROUP BY {P}, sent_id, row_id""")
def sentence_bboxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of each sentence of a page, one for each row it runs over."""
    return sg.sentence_boxes(g.rows(_T(spark, d)), g.PAGE).withColumn("row_id", F.col("row_id").cast("long"))


# ---- layout tables -------------------------------------------------------------------------------


@query(f"""{v.LAYOUT} SELECT {P}, CAST(block_id AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS text, type AS category, -1 AS parent, confidence, true AS is_block FROM blocks
UNION ALL SELECT {P}, token_id, text, type, parent, confidence, false FROM tokens""")
def layout_to_table(spark: SparkSession, d: str) -> DataFrame:
    return lo.to_table(_B(spark, d), _T(spark, d))


@query(f"""{v.LAYOUT}, c AS (SELECT {P}, parent, type, count(*) AS n, min(token_id) AS f FROM tokens WHERE parent IS NOT NULL AND type IS NOT NULL GROUP BY {P}, parent, type),
r AS (SELECT *, row_number() OVER (PARTITION BY {P}, parent ORDER BY n DESC, f) AS rn FROM c) SELECT {P}, parent, type FROM r WHERE rn = 1""")
def modal_type_vote(spark: SparkSession, d: str) -> DataFrame:
    return lo.modal(_T(spark, d).where("parent IS NOT NULL AND type IS NOT NULL"), [*g.PAGE, "parent"], "type", "token_id")


@query(f"{v.LAYOUT} SELECT {P}, string_agg(coalesce(text, ''), '|' ORDER BY token_id) AS words, string_agg(coalesce(type, ''), '|' ORDER BY token_id) AS labels, string_agg(CAST(coalesce(parent, -1) AS VARCHAR), '|' ORDER BY token_id) AS block_ids FROM tokens GROUP BY {P}")
def group_page_arrays(spark: SparkSession, d: str) -> DataFrame:
    a = lo.page_arrays(_T(spark, d))
    return a.select(*g.PAGE, *[F.array_join(c, "|").alias(c) for c in ("words", "labels", "block_ids")])


@query(f"{v.LAYOUT} SELECT {P}, parent, string_agg(coalesce(text, ''), '|' ORDER BY token_id) AS words, arg_min(coalesce(type, ''), token_id) AS category FROM tokens WHERE parent IS NOT NULL GROUP BY {P}, parent")
def segment_level(spark: SparkSession, d: str) -> DataFrame:
    return lo.segments(_T(spark, d)).select(*g.PAGE, "parent", F.array_join("words", "|").alias("words"), "category")


@query(f"{v.LAYOUT} SELECT {P}, block_id, string_agg(coalesce(t.text, ''), ' ' ORDER BY token_id) AS text FROM blocks b JOIN tokens t ON t.record_id = b.record_id AND t.page_pos = b.page_pos AND t.parent = b.block_id GROUP BY ALL".replace(f"SELECT {P}, block_id, string", "SELECT b.record_id, b.page_pos, b.block_id, string"))
def block_text(spark: SparkSession, d: str) -> DataFrame:
    return lo.block_text(_B(spark, d), _T(spark, d))


@query(f"{v.LAYOUT} SELECT t.record_id, t.page_pos, t.token_id, CASE WHEN t.parent IS NOT NULL AND b.block_id IS NOT NULL THEN b.type ELSE t.type END AS type FROM tokens t LEFT JOIN blocks b ON b.record_id = t.record_id AND b.page_pos = t.page_pos AND b.block_id = t.parent")
def inherit_block_class(spark: SparkSession, d: str) -> DataFrame:
    return lo.inherit(_B(spark, d), _T(spark, d)).select(*g.PAGE, "token_id", "type")


@query(f"""{v.LAYOUT}, c AS (SELECT {P}, parent, type, count(*) AS n, min(token_id) AS f FROM tokens WHERE parent IS NOT NULL AND type IS NOT NULL GROUP BY {P}, parent, type),
r AS (SELECT *, row_number() OVER (PARTITION BY {P}, parent ORDER BY n DESC, f) AS rn FROM c),
m AS (SELECT {P}, parent AS block_id, type AS vote FROM r WHERE rn = 1)
SELECT b.record_id, b.page_pos, b.block_id, CASE WHEN b.type IN ('text', 'title', 'list') THEN m.vote ELSE b.type END AS type FROM blocks b LEFT JOIN m USING ({P}, block_id)""")
def vote_rule(spark: SparkSession, d: str) -> DataFrame:
    return lo.vote_textual(_B(spark, d), _T(spark, d))


@query(f"{v.LAYOUT}, m AS (SELECT {P}, parent AS block_id, arg_min({{'t': type}}, token_id).t AS vote FROM tokens WHERE parent IS NOT NULL GROUP BY {P}, parent) SELECT b.record_id, b.page_pos, b.block_id, CASE WHEN b.type IN ('text', 'title', 'list') THEN m.vote ELSE b.type END AS type FROM blocks b LEFT JOIN m USING ({P}, block_id)")
def first_token_rule(spark: SparkSession, d: str) -> DataFrame:
    return lo.first_textual(_B(spark, d), _T(spark, d))


@query(f"{v.LAYOUT} SELECT {P}, token_id FROM tokens WHERE text IS NOT NULL AND NOT regexp_matches(text, '^\\s+$')")
def drop_blank_text(spark: SparkSession, d: str) -> DataFrame:
    return _T(spark, d).where(r"text IS NOT NULL AND NOT text RLIKE '^\\s+$'").select(*g.PAGE, "token_id")


@query(f"{v.LAYOUT} SELECT {P}, token_id, coalesce(least(parent + 1, 32), 0) AS block_no FROM tokens")
def block_id_clamp(spark: SparkSession, d: str) -> DataFrame:
    return _T(spark, d).select(*g.PAGE, "token_id", lo.clamp_block(F.col("parent")).alias("block_no"))


@query(f"{v.LAYOUT} SELECT {P} FROM tokens GROUP BY {P} HAVING max(coalesce(parent, -1)) + 1 < 32")
def max_blocks_filter(spark: SparkSession, d: str) -> DataFrame:
    return _T(spark, d).groupBy(*g.PAGE).agg(F.max(F.coalesce("parent", F.lit(-1))).alias("m")).where("m + 1 < 32").select(*g.PAGE)


_MAP = ", ".join(f"'{k}': {i}" for k, i in lo.LABELS.items())


@query(f"{v.LAYOUT} SELECT {P}, token_id, element_at(MAP {{{_MAP}}}, type) AS label_id FROM tokens WHERE type IS NOT NULL".replace("element_at(MAP {" + _MAP + "}, type)", "(MAP {" + _MAP + "})[type]"))
def category_ids(spark: SparkSession, d: str) -> DataFrame:
    return _T(spark, d).where("type IS NOT NULL").select(*g.PAGE, "token_id", lo.label_id(F.col("type")).alias("label_id"))


_FONTS = "f AS (SELECT doc_id, concat(upper(substr(md5(text), 1, 6)), '+F', CAST(doc_id % 7 AS VARCHAR)) AS font FROM documents WHERE text IS NOT NULL)"


def _fonts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat(F.upper(F.substring(F.md5("text"), 1, 6)), F.lit("+F"), (F.col("doc_id") % 7).cast("string")).alias("font"))


@query(f"WITH {_FONTS} SELECT doc_id, regexp_replace(font, '(\\S{{6}})\\+', '', 'g') AS font FROM f")
def font_clean(spark: SparkSession, d: str) -> DataFrame:
    from vellumine.functions.text import clean_font

    return _fonts(spark, d).select("doc_id", clean_font(F.col("font")).alias("font"))


@query(f"WITH {_FONTS}, c AS (SELECT doc_id, regexp_replace(font, '(\\S{{6}})\\+', '', 'g') AS font FROM f) SELECT doc_id, CASE WHEN font = 'F0' THEN 5 WHEN font = 'F1' THEN 6 WHEN font = 'F2' THEN 7 ELSE 1 END AS font_id FROM c")
def font_encode(spark: SparkSession, d: str) -> DataFrame:
    return _fonts(spark, d).select("doc_id", lo.font_id(F.col("font"), ["F0", "F1", "F2"]).alias("font_id"))


@query(f"WITH {_FONTS}, c AS (SELECT doc_id, regexp_replace(font, '(\\S{{6}})\\+', '', 'g') AS font FROM f) SELECT font, count(*) AS n FROM c GROUP BY font HAVING count(*) > 2")
def font_vocab(spark: SparkSession, d: str) -> DataFrame:
    return lo.font_vocabulary(_fonts(spark, d), 2)


_BOTH = """, a AS (SELECT DISTINCT t.text AS word FROM tokens t WHERE t.parent IS NOT NULL AND t.text IS NOT NULL AND t.text <> ''),
b AS (SELECT DISTINCT t.text AS word FROM tokens t WHERE t.parent IS NULL AND t.text IS NOT NULL AND t.text <> '')"""


def _vocabularies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two vocabularies: the words of blocks and those outside of blocks."""
    t = _T(spark, d).where("text IS NOT NULL AND text <> ''")
    return tuple(t.where(f"parent IS {n} NULL").select(F.col("text").alias("word")).distinct() for n in ("NOT", ""))


@query(f"{v.LAYOUT}{_BOTH} SELECT word FROM a INTERSECT SELECT word FROM b")
def font_intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b = _vocabularies(spark, d)
    return a.intersect(b)


@query(f"{v.LAYOUT}{_BOTH} SELECT a.word, b.word AS near FROM a JOIN b ON a.word <> b.word AND levenshtein(a.word, b.word) <= 1")
def fuzzy_font(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of words of both vocabularies that one edit turns into each other."""
    return lo.near_words(*_vocabularies(spark, d))


@query(f"{v.LAYOUT}, c AS (SELECT text, type, count(*) AS n FROM tokens WHERE text IS NOT NULL AND type IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY n DESC, type) AS k FROM c) SELECT text, type, n FROM r WHERE k = 1")
def modal_type_per_word(spark: SparkSession, d: str) -> DataFrame:
    counts = _T(spark, d).where("text IS NOT NULL AND type IS NOT NULL").groupBy("text", "type").agg(F.count("*").alias("n"))
    return counts.groupBy("text").agg(F.min(F.struct((-F.col("n")).alias("m"), "type", "n")).alias("b")).select("text", "b.type", "b.n")


_COCO = f"""{v.LAYOUT}, images AS (SELECT record_id * 1000 + page_pos AS image_id, record_id, page_pos, record_id || '_' || page_pos || '.jpg' AS file_name, width, height FROM pages_v),
categories AS (SELECT type AS name, row_number() OVER (ORDER BY type) AS category_id FROM (SELECT DISTINCT type FROM blocks WHERE type IS NOT NULL)),
annotations AS (SELECT i.image_id, b.block_id, c.category_id, b.x1, b.y1, b.x2 - b.x1 AS w, b.y2 - b.y1 AS h FROM blocks b JOIN images i USING (record_id, page_pos) JOIN categories c ON c.name = b.type)"""


@query(f"{_COCO} SELECT i.file_name, i.width, i.height, c.name AS category, a.block_id, a.x1 AS x, a.y1 AS y, a.w, a.h FROM annotations a JOIN images i USING (image_id) JOIN categories c USING (category_id)")
def coco_blocks(spark: SparkSession, d: str) -> DataFrame:
    """An annotation set read back: annotations with their image and the name of their category."""
    return lo.coco_blocks(*lo.coco_tables(canonical.pages(spark, d), _B(spark, d)))


@query(f"{_COCO} SELECT i.file_name, i.image_id, i.width, i.height, count(a.block_id) AS n FROM images i LEFT JOIN annotations a USING (image_id) GROUP BY ALL")
def coco_image_info(spark: SparkSession, d: str) -> DataFrame:
    images, annotations, _ = lo.coco_tables(canonical.pages(spark, d), _B(spark, d))
    n = annotations.groupBy("image_id").agg(F.count("*").alias("n"))
    return images.join(n, "image_id", "left").select("file_name", "image_id", "width", "height", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT input_id FROM ssc_input WHERE sentences IS NOT NULL AND (len(sentences) = 0 OR list_contains(list_transform(sentences, lambda x: x IS NULL), true))")
def problematic_items(spark: SparkSession, d: str) -> DataFrame:
    return lo.problematic(table(spark, d, "ssc_input").where("sentences IS NOT NULL"), "sentences").select("input_id")


@query("SELECT input_id FROM ssc_input WHERE sentences IS NOT NULL AND NOT (len(sentences) = 0 OR list_contains(list_transform(sentences, lambda x: x IS NULL), true))")
def drop_problematic(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ssc_input").where("sentences IS NOT NULL")
    return rows.select("input_id").join(lo.problematic(rows, "sentences").select("input_id"), "input_id", "left_anti")


@query(f"{v.LAYOUT} SELECT {P}, type, count(*) AS n FROM blocks GROUP BY {P}, type")
def blocks_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _B(spark, d).groupBy(*g.PAGE, "type").agg(F.count("*").alias("n"))


@query(f"{v.LAYOUT} SELECT record_id, string_agg(coalesce(t.text, ''), ' ' ORDER BY t.page_pos, t.token_id) AS title FROM tokens t JOIN blocks b USING ({P}) WHERE t.parent = b.block_id AND b.type = 'title' GROUP BY record_id")
def title_extract(spark: SparkSession, d: str) -> DataFrame:
    t = _T(spark, d).join(_B(spark, d).where("type = 'title'").select(*g.PAGE, F.col("block_id").alias("parent")), [*g.PAGE, "parent"])
    words = F.transform(F.array_sort(F.collect_list(F.struct("page_pos", "token_id", F.coalesce("text", F.lit("")).alias("w")))), lambda x: x["w"])
    return t.groupBy("record_id").agg(F.array_join(words, " ").alias("title"))


@query("SELECT record_id, page_pos FROM (SELECT record_id, unnest(range(len(pages))) AS page_pos, unnest(pages) AS p FROM layouts) l JOIN (SELECT DISTINCT record_id AS rid FROM raw_records) r ON l.record_id = r.rid WHERE p IS NOT NULL AND p.layout IS NULL")
def pages_without_layout(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "layouts").select("record_id", F.posexplode("pages").alias("page_pos", "p")).where("p IS NOT NULL AND p.layout IS NULL")
    return p.join(table(spark, d, "raw_records").select("record_id"), "record_id", "left_semi").select("record_id", "page_pos")


@query("SELECT l.record_id, p.id AS paper FROM layouts l LEFT JOIN (SELECT paper_sha, min(id) AS id FROM papers WHERE paper_sha IS NOT NULL GROUP BY 1) p USING (paper_sha)")
def layouts_to_papers(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers").where("paper_sha IS NOT NULL").groupBy("paper_sha").agg(F.min("id").alias("paper"))
    return table(spark, d, "layouts").select("record_id", "paper_sha").join(papers, "paper_sha", "left").select("record_id", "paper")


# ---- three-level tables, spans and display -----------------------------------------------------------


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return lo.levels(_B(spark, d), g.rows(_T(spark, d)))


_LEVELS = f"""lv AS (SELECT {P}, CAST(block_id AS BIGINT) AS id, x1, y1, x2, y2, CAST(NULL AS VARCHAR) AS text, type AS category, -1 AS block_id, CAST(-1 AS BIGINT) AS line_id, true AS is_block, false AS is_line FROM blocks
UNION ALL SELECT {P}, CAST(row_id AS BIGINT), min(x1), min(y1), max(x2), max(y2), string_agg(coalesce(text, ''), ' ' ORDER BY token_id), arg_min({{'t': type}}, token_id).t, coalesce(parent, -1), -1, false, true FROM clustered GROUP BY {P}, row_id, coalesce(parent, -1)
UNION ALL SELECT {P}, token_id, x1, y1, x2, y2, text, type, coalesce(parent, -1), CAST(row_id AS BIGINT), false, false FROM clustered)"""


@query(f"{v.LAYOUT}, {_ROWS}, {_LEVELS} SELECT * FROM lv")
def three_level_table(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)


@query(f"{v.LAYOUT}, {_ROWS}, {_LEVELS} SELECT {P}, id FROM lv WHERE NOT is_block AND NOT is_line")
def level_filter(spark: SparkSession, d: str) -> DataFrame:
    return lo.words_of(_levels(spark, d)).select(*g.PAGE, "id")


@query(f"{v.LAYOUT}, {_ROWS}, {_LEVELS}, l AS (SELECT {P}, id AS line_id, min(block_id) AS line_block FROM lv WHERE is_line GROUP BY {P}, id) SELECT {P}, id, line_id, line_block FROM lv LEFT JOIN l USING ({P}, line_id) WHERE NOT is_block AND NOT is_line")
def parent_resolution(spark: SparkSession, d: str) -> DataFrame:
    return lo.with_line_parent(_levels(spark, d)).select(*g.PAGE, "id", "line_id", "line_block")


@query()
def page_level_json(spark: SparkSession, d: str) -> DataFrame:
    return lo.page_json(_levels(spark, d))


@query()
def table_to_layout(spark: SparkSession, d: str) -> DataFrame:
    return lo.from_table(lo.to_table(_B(spark, d), _T(spark, d)))


@query(f"{v.LAYOUT}, {_ROWS}, {_LEVELS}, w AS (SELECT {P}, block_id, string_agg(coalesce(text, ''), ' ' ORDER BY id) AS text FROM lv WHERE NOT is_block AND NOT is_line GROUP BY {P}, block_id) SELECT b.record_id, b.page_pos, b.block_id, b.type, w.text FROM blocks b LEFT JOIN w USING ({P}, block_id)")
def bundles_from_levels(spark: SparkSession, d: str) -> DataFrame:
    return lo.bundles_from_levels(_levels(spark, d)).select(*g.PAGE, "block_id", "type", "text")


@query(f"{v.LAYOUT}, {_HIT}, a AS (SELECT {P}, token_id, arg_min({{'t': btype}}, block_id).t AS btype FROM hits GROUP BY {P}, token_id) SELECT {P}, token_id, CASE WHEN a.token_id IS NOT NULL THEN a.btype ELSE t.type END AS type FROM tokens t LEFT JOIN a USING ({P}, token_id)".replace("a.token_id IS NOT NULL", "a.hit").replace("arg_min({'t': btype}, block_id).t AS btype", "arg_min({'t': btype}, block_id).t AS btype, true AS hit"))
def ground_truth_layout(spark: SparkSession, d: str) -> DataFrame:
    tokens, blocks = _T(spark, d), _B(spark, d)
    placed = tokens.drop("parent").join(g.assign(tokens, blocks).withColumnRenamed("block_id", "parent"), [*g.PAGE, "token_id"])
    return lo.inherit(blocks, placed).select(*g.PAGE, "token_id", "type")


@query(f"{v.LAYOUT} SELECT p.record_id, p.page_pos, round(q.width / p.width, 6) AS fx, round(q.height / p.height, 6) AS fy FROM pages_v p JOIN pages_v q ON q.record_id = p.record_id AND q.page_pos = 0")
def image_resize(spark: SparkSession, d: str) -> DataFrame:
    p = canonical.pages(spark, d)
    q = p.where("page_pos = 0").select("record_id", F.col("width").alias("w0"), F.col("height").alias("h0"))
    return p.join(q, "record_id").select(*g.PAGE, F.round(F.col("w0") / F.col("width"), 6).alias("fx"), F.round(F.col("h0") / F.col("height"), 6).alias("fy"))


@query(rf"""{v.LAYOUT}, {_ROWS}, sp AS (SELECT b.record_id, b.page_pos, b.block_id AS span_id, string_agg(coalesce(t.text, ''), ' ' ORDER BY t.token_id) AS span FROM blocks b JOIN tokens t ON t.record_id = b.record_id AND t.page_pos = b.page_pos AND t.parent = b.block_id GROUP BY ALL),
m AS (SELECT c.record_id, c.page_pos, span_id, token_id, row_id, x1, y1, x2, y2, token_id - row_number() OVER (PARTITION BY c.record_id, c.page_pos, span_id ORDER BY token_id) AS grp
  FROM clustered c JOIN sp ON sp.record_id = c.record_id AND sp.page_pos = c.page_pos
  WHERE c.text IS NOT NULL AND c.text <> '' AND strpos(lower(replace(span, ' - ', '-')), lower(regexp_replace(c.text, '^[!-/:-@\[-`{{-~]+|[!-/:-@\[-`{{-~]+$', '', 'g'))) > 0),
u AS (SELECT {P}, span_id, grp, count(*) AS n, min(token_id) AS f FROM m GROUP BY {P}, span_id, grp),
w AS (SELECT *, row_number() OVER (PARTITION BY {P}, span_id ORDER BY n DESC, f) AS rn FROM u)
SELECT m.record_id, m.page_pos, m.span_id, m.row_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM m JOIN w ON w.record_id = m.record_id AND w.page_pos = m.page_pos AND w.span_id = m.span_id AND w.grp = m.grp AND w.rn = 1 GROUP BY ALL""")
def span_bboxes(spark: SparkSession, d: str) -> DataFrame:
    t = g.rows(_T(spark, d))
    spans = lo.block_text(_B(spark, d), _T(spark, d)).select(*g.PAGE, F.col("block_id").alias("span_id"), F.col("text").alias("span"))
    return sg.span_boxes(t, spans, g.PAGE)


@query(f"{_WORDS}, f AS (SELECT doc_id, token_id, token_id - row_number() OVER (PARTITION BY doc_id ORDER BY token_id) AS grp FROM words WHERE length(token) >= 5), i AS (SELECT doc_id, grp, min(token_id) AS start, count(*) AS length FROM f GROUP BY 1, 2) SELECT w.doc_id, w.token_id, min(i.start) AS chunk FROM words w JOIN i ON i.doc_id = w.doc_id AND w.token_id >= i.start AND w.token_id < i.start + i.length GROUP BY 1, 2")
def token_to_chunk(spark: SparkSession, d: str) -> DataFrame:
    words = sg.words(table(spark, d, "documents"), "doc_id")
    return sg.in_chunks(words, sg.islands(words.where("char_length(token) >= 5"), "doc_id", "token_id"), "doc_id")


@query("SELECT id, instr(lower(replace(title, ' - ', '-')), lower(regexp_extract(title, '[A-Za-z]+$', 0))) - 1 AS at FROM papers WHERE title IS NOT NULL")
def span_find(spark: SparkSession, d: str) -> DataFrame:
    last = F.regexp_extract("title", "[A-Za-z]+$", 0)
    return table(spark, d, "papers").where("title IS NOT NULL").select("id", sg.span_match(F.col("title"), last).alias("at"))


@query(f"{v.LAYOUT} SELECT {P}, block_id, coalesce(upper(substr(type, 1, 1)) || lower(substr(type, 2)), 'Not Used') AS shown FROM blocks")
def display_types(spark: SparkSession, d: str) -> DataFrame:
    from vellumine.functions.text import display_type

    return _B(spark, d).select(*g.PAGE, "block_id", display_type(F.col("type")).alias("shown"))


_COLOURS = " ".join(f"WHEN type = '{k}' THEN '{c}'" for k, c in lo.COLOURS.items() if k)


@query(f"{v.LAYOUT}, c AS (SELECT {P}, block_id, CASE {_COLOURS} ELSE '{lo.COLOURS[None]}' END AS hex FROM blocks) SELECT {P}, block_id, hex, CAST('0x' || substr(hex, 2, 2) AS INTEGER) AS red, CAST('0x' || substr(hex, 6, 2) AS INTEGER) AS blue FROM c")
def block_colours(spark: SparkSession, d: str) -> DataFrame:
    from vellumine.functions.text import red_green_blue

    known = F.create_map(*[x for k, c in lo.COLOURS.items() if k for x in (F.lit(k), F.lit(c))])
    hexes = F.coalesce(F.try_element_at(known, "type"), F.lit(lo.COLOURS[None]))
    return _B(spark, d).select(*g.PAGE, "block_id", hexes.alias("hex")).withColumn("c", red_green_blue(F.col("hex"))).select(*g.PAGE, "block_id", "hex", F.col("c")[0].alias("red"), F.col("c")[2].alias("blue"))


@query("SELECT unnest(['" + "', '".join(lo.LABELS) + "']) AS label, CAST(unnest(range(13)) AS INTEGER) AS id")
def label_map(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in lo.LABELS])).alias("id", "label"))


@query(f"{v.LAYOUT} SELECT type, count(*) AS n FROM blocks WHERE type IS NOT NULL AND type NOT IN ('paragraph', 'list', 'title') GROUP BY type")
def font_oov(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("paragraph",), ("list",), ("title",)], "type string")
    return _B(spark, d).where("type IS NOT NULL").join(known, "type", "left_anti").groupBy("type").agg(F.count("*").alias("n"))


@query(r"SELECT id, regexp_extract(paper_id, '^([a-z]*)', 1) AS venue, regexp_extract(paper_id, '(\d+)[.-](\d+)$', 1) AS number, regexp_extract(paper_id, '(\d+)$', 1) AS item FROM papers")
def paper_name_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("id", F.regexp_extract("paper_id", r"^([a-z]*)", 1).alias("venue"), F.regexp_extract("paper_id", r"(\d+)[.-](\d+)$", 1).alias("number"), F.regexp_extract("paper_id", r"(\d+)$", 1).alias("item"))


@query(f"""{v.LAYOUT}, x AS (SELECT {P}, token_id, type, y1, y2, unnest(range(CAST(floor(x1 / 4) AS BIGINT), CAST(floor(x2 / 4) AS BIGINT) + 1)) AS px FROM tokens WHERE x2 >= x1 AND y2 >= y1 AND type IS NOT NULL),
y AS (SELECT {P}, token_id, type, px, unnest(range(CAST(floor(y1 / 4) AS BIGINT), CAST(floor(y2 / 4) AS BIGINT) + 1)) AS py FROM x)
SELECT {P}, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, arg_max(type, token_id) AS type FROM y GROUP BY ALL""")
def token_mask(spark: SparkSession, d: str) -> DataFrame:
    return lo.mask_pixels(_T(spark, d))


@query(f"""{v.LAYOUT}, o AS (SELECT t.*, b.type AS bt, row_number() OVER (PARTITION BY t.record_id, t.page_pos, t.parent ORDER BY t.token_id) - 1 AS k FROM tokens t JOIN blocks b ON b.record_id = t.record_id AND b.page_pos = t.page_pos AND b.block_id = t.parent),
n AS (SELECT {P}, parent, token_id, k, CASE WHEN bt = 'figure' THEN 'figure' WHEN bt = 'caption' AND k < 3 THEN max(CASE WHEN k = 3 THEN type END) OVER (PARTITION BY {P}, parent) ELSE type END AS type FROM o)
SELECT b.record_id, b.page_pos, b.block_id, coalesce(n.type, b.type) AS type FROM blocks b LEFT JOIN n ON n.record_id = b.record_id AND n.page_pos = b.page_pos AND n.parent = b.block_id AND n.k = 0""")
def true_blocks_typed(spark: SparkSession, d: str) -> DataFrame:
    """True blocks typed by their tokens' detected types: caption labels are skipped, figures stay figures."""
    return lo.true_blocks_typed(_B(spark, d), _T(spark, d))[0].select(*g.PAGE, "block_id", "type")


_PACK = f"""{v.LAYOUT}, g AS (SELECT {P}, token_id, text, CAST(coalesce(length(type), 0) AS INTEGER) AS label, CAST(floor(x1 / pw * 1000) AS INTEGER) AS bx FROM tokens WHERE text IS NOT NULL AND text <> '' AND pw > 0),
q AS (SELECT {P}, token_id, label, bx, regexp_extract_all(text, '.{{1,4}}') AS ps FROM g),
e AS (SELECT {P}, token_id, label, bx, unnest(range(len(ps))) AS k FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY {P} ORDER BY token_id, k) - 1 AS pos FROM e),
w AS (SELECT {P}, CAST(pos // 510 AS INTEGER) AS win, list(CASE WHEN k = 0 THEN label ELSE -1 END ORDER BY pos) AS ls, list(bx ORDER BY pos) AS bs FROM n GROUP BY ALL)
SELECT {P}, win, '-1,' || array_to_string(ls, ',') || ',-1' || repeat(',-1', CAST(510 - len(ls) AS BIGINT)) AS labels, len(ls) + 2 AS used, '0,' || array_to_string(bs, ',') || ',1000' || repeat(',0', CAST(510 - len(bs) AS BIGINT)) AS boxes FROM w"""


@query(_PACK)
def window_pack_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 512 places with labels, mask and boxes (of which the left edge is shown)."""
    t = _T(spark, d).where("text IS NOT NULL AND text <> '' AND pw > 0")
    t = t.withColumn("label", F.coalesce(F.char_length("type"), F.lit(0))).withColumn("bx", F.floor(F.col("x1") / F.col("pw") * 1000).cast("int"))
    w = sq.boxed_windows(t, g.PAGE, "label", ["bx"])
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return w.select(*g.PAGE, "win", joined("labels").alias("labels"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias("used"), joined("bx").alias("boxes"))


@query(f"{v.LAYOUT} SELECT record_id, count(*) AS pages, max(width) AS width, max(height) AS height FROM pages_v GROUP BY record_id")
def page_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of pages of each record and the size of its largest."""
    return canonical.pages(spark, d).groupBy("record_id").agg(F.count("*").alias("pages"), F.max("width").alias("width"), F.max("height").alias("height"))
