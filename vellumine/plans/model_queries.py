"""Queries over predictions, metrics, sequences and data sets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import datasets as ds
from vellumine.operators import geometry as gm
from vellumine.operators import layout as lo
from vellumine.operators import metrics as mt
from vellumine.operators import rank as rk
from vellumine.operators import scorers as sc
from vellumine.operators import segment as sg
from vellumine.operators import sequence as sq
from vellumine.plans import sqlviews as v
from vellumine.plans.layout_queries import _HIT
from vellumine.plans.text_queries import SQL as _TEXT_SQL
from vellumine.session import shared_dir
from vellumine.sources import canonical
from vellumine.sources.tables import table
from vellumine.streaming import facets as fs

QUERIES, SQL = {}, {}
SQL_FACETS = _TEXT_SQL["facet_counts"]
# The stand-in scorers take a number in [0, 1) from a digest; DuckDB can do the same.
_UNIT = "(CAST('0x' || substr(md5('{1}:' || {0}), 1, 12) AS UBIGINT) / 281474976710656.0)"
_DETECTED = f"d AS (SELECT record_id, page_pos, token_id, ['paragraph', 'title', 'list', 'caption'][1 + CAST(floor({_UNIT.format('text', 0)} * 4) AS INTEGER)] AS type, {_UNIT.format('text', 1)} AS score FROM tokens WHERE text IS NOT NULL AND text <> '')"
_SOFT = ", ".join(f"exp(4 * {_UNIT.format('sentence', k)})" for k in range(5))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- ranking -------------------------------------------------------------------------------------

_BEST = "ORDER BY prob DESC, pos, pred_id"


@query(f"{v.PREDS}, r AS (SELECT *, row_number() OVER (PARTITION BY paper_id, label {_BEST}) AS rank FROM preds) SELECT pred_id, paper_id, label, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def topk_per_label(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("prob").desc(), F.col("pos"), F.col("pred_id")]
    return rk.top_k(canonical.predictions(spark, d), ["paper_id", "label"], order, 5).select("pred_id", "paper_id", "label", "rank")


def _capped(label: str, per_block: int, overall: int | None) -> str:
    return f"""{v.PREDS}, a AS (SELECT *, row_number() OVER (PARTITION BY paper_id, block_id {_BEST}) AS rb FROM preds WHERE label = '{label}'),
b AS (SELECT *, sum(CASE WHEN rb = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id {_BEST} ROWS UNBOUNDED PRECEDING) AS seen FROM a)
SELECT pred_id, paper_id, block_id, prob FROM b WHERE rb <= {per_block}""" + (f" AND seen < {overall}" if overall else "")


def _capped_query(label: str, per_block: int, overall: int | None):
    return lambda spark, d: rk.top_k_group_capped(canonical.predictions(spark, d), label, per_block, overall).select("pred_id", "paper_id", "block_id", "prob")


for _label, _per, _all in (("Objective", 1, 3), ("Method", 2, None), ("Result", 1, None)):
    QUERIES[f"top_pred_by_block_{_label.lower()}"] = _capped_query(_label, _per, _all)
    SQL[f"top_pred_by_block_{_label.lower()}"] = _capped(_label, _per, _all)


@query(f"{v.SCORES} SELECT vec_id, list_position(logits, list_max(logits)) - 1 AS best FROM scores")
def argmax_label(spark: SparkSession, d: str) -> DataFrame:
    return canonical.scores(spark, d).select("vec_id", rk.argmax(F.col("logits")).alias("best"))


@query(f"{v.SCORES}, e AS (SELECT vec_id, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM scores) SELECT vec_id, round(list_max(list_transform(e, lambda x: x / list_sum(e))), 6) AS prob FROM e")
def softmax_prob(spark: SparkSession, d: str) -> DataFrame:
    return canonical.scores(spark, d).select("vec_id", F.round(F.array_max(rk.softmax(F.col("logits"))), 6).alias("prob"))


@query(f"{v.SCORES}, r AS (SELECT vec_id, vec_id // 25 AS paper, row_number() OVER (PARTITION BY vec_id // 25 ORDER BY logits DESC, vec_id) - 1 AS pos FROM scores) SELECT vec_id, paper, CAST(pos AS INTEGER) AS pos FROM r")
def lexicographic_scores(spark: SparkSession, d: str) -> DataFrame:
    s = canonical.scores(spark, d).withColumn("paper", F.expr("vec_id div 25"))
    return rk.top_k(s, ["paper"], [F.col("logits").desc(), F.col("vec_id")], 25).select("vec_id", "paper", (F.col("rank") - 1).alias("pos"))


@query(f"{v.PREDS}, r AS (SELECT *, row_number() OVER (PARTITION BY paper_id {_BEST}) AS k FROM preds) SELECT pred_id, paper_id, prob FROM r WHERE k <= 10")
def top10_sentences(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("prob").desc(), F.col("pos"), F.col("pred_id")]
    return rk.top_k(canonical.predictions(spark, d), ["paper_id"], order, 10).select("pred_id", "paper_id", "prob")


@query("WITH r AS (SELECT doc_id, kind, lang, row_number() OVER (PARTITION BY kind, lang ORDER BY md5('h' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents) SELECT doc_id, kind, lang FROM r WHERE k <= 2")
def head2_per_group(spark: SparkSession, d: str) -> DataFrame:
    return ds.head_per_group(table(spark, d, "documents").select("doc_id", "kind", "lang"), ["kind", "lang"], "doc_id", 2)


@query("SELECT section_id FROM sections ORDER BY section_id LIMIT 24")
def first_24(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").select("section_id").orderBy("section_id").limit(24)


@query(r"SELECT arg_max(paper_id, CAST(regexp_extract(paper_id, '(\d+)$', 1) AS BIGINT) * 1000000 + id) AS latest FROM papers WHERE regexp_matches(paper_id, '^conf\d+-\d+$')")
def latest_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("paper_id", r"(\d+)$", 1).cast("long")
    return table(spark, d, "papers").where(r"paper_id RLIKE '^conf\\d+-\\d+$'").agg(F.max_by("paper_id", F.struct(n.alias("n"), "id")).alias("latest"))


@query("SELECT input_id, len(sentences) AS n FROM ssc_input WHERE sentences IS NOT NULL AND len(sentences) > 0 AND len(sentences) = len(list_filter(sentences, lambda x: x IS NOT NULL))")
def zip_scores_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ssc_input").where("size(sentences) > 0").withColumn("lengths", F.transform(F.filter("sentences", lambda s: s.isNotNull()), lambda s: F.char_length(s)))
    return rows.where(F.size("sentences") == F.size("lengths")).select("input_id", F.size("sentences").alias("n"))


@query(f"{v.PREDS}, b AS (SELECT paper_id, sentence, count(*) AS n FROM preds GROUP BY 1, 2), s AS (SELECT paper_id, unnest(sentences) AS sentence FROM ssc_input) SELECT b.paper_id, b.sentence, b.n, count(s.sentence) AS places FROM b LEFT JOIN s ON s.paper_id = b.paper_id AND s.sentence = b.sentence GROUP BY 1, 2, 3")
def predictions_to_sentences(spark: SparkSession, d: str) -> DataFrame:
    # both sides are counted before the join: a sentence repeated in a large paper meets one row
    p = canonical.predictions(spark, d).groupBy("paper_id", "sentence").agg(F.count("*").alias("n"))
    s = table(spark, d, "ssc_input").select("paper_id", F.explode("sentences").alias("sentence")).groupBy("paper_id", "sentence").agg(F.count("*").alias("places"))
    return p.join(s, ["paper_id", "sentence"], "left").fillna(0, ["places"])


@query(f"{v.PREDS} SELECT paper_id, label, count(*) AS n, round(avg(prob), 4) AS mean_prob FROM preds GROUP BY 1, 2")
def predictions_by_label(spark: SparkSession, d: str) -> DataFrame:
    return canonical.predictions(spark, d).groupBy("paper_id", "label").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 4).alias("mean_prob"))


# ---- metrics -------------------------------------------------------------------------------------

_GT = "WITH g AS (SELECT vec_id, label AS gt, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE list_position(embedding[1:10], list_max(embedding[1:10])) - 1 END AS pred, 1 + vec_id % 7 AS w FROM embeddings)"
_CLASS = """c AS (SELECT gt, sum(CASE WHEN gt = pred THEN {w} ELSE 0 END) AS tp, sum({w}) AS support FROM g GROUP BY gt),
p AS (SELECT pred AS gt, sum({w}) AS guessed FROM g WHERE pred IS NOT NULL GROUP BY pred),
m AS (SELECT c.gt AS label, support, CASE WHEN coalesce(guessed, 0) > 0 THEN tp / guessed ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM c LEFT JOIN p USING (gt)),
k AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)"""


def _gt(spark: SparkSession, d: str) -> DataFrame:
    first = F.slice("embedding", 1, 10)
    pred = F.when(F.col("vec_id") % 11 == 0, F.lit(None)).otherwise(rk.argmax(first))
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("gt"), pred.alias("pred"), (F.col("vec_id") % 7 + 1).alias("w"))


def _conf(spark: SparkSession, d: str) -> DataFrame:
    return mt.confusion(_gt(spark, d), weight=F.col("w"))


@query(f"{_GT} SELECT gt, pred, count(*) AS n FROM g GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _conf(spark, d).select("gt", "pred", "n")


@query(f"{_GT} SELECT round(avg(CASE WHEN gt = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM g")
def token_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return mt.accuracy(_conf(spark, d)).select(F.round("accuracy", 6).alias("accuracy"))


@query(f"{_GT}, {_CLASS.format(w=1)} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM k")
def prf_per_class(spark: SparkSession, d: str) -> DataFrame:
    return mt.by_class(_conf(spark, d)).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("long").alias("support"))


@query(f"{_GT} SELECT round(sum(CASE WHEN gt = pred THEN 1 ELSE 0 END) / count(pred), 6) AS precision, round(sum(CASE WHEN gt = pred THEN 1 ELSE 0 END) / count(*), 6) AS recall FROM g")
def prf_micro(spark: SparkSession, d: str) -> DataFrame:
    return mt.micro(_conf(spark, d)).select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"{_GT}, {_CLASS.format(w='w')} SELECT round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM k")
def prf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return mt.weighted(_conf(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"{_GT}, {_CLASS.format(w=1)} SELECT round(avg(f1), 6) AS macro_f1, count(*) AS classes FROM k")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return mt.macro(_conf(spark, d)).select(F.round("macro_f1", 6).alias("macro_f1"), "classes")


@query("WITH n AS (SELECT label, count(*) AS n FROM ssc_preds WHERE label IS NOT NULL GROUP BY 1) SELECT label, n, round(-ln(n / (SELECT sum(n) FROM n)), 6) AS weight FROM n")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return mt.class_weights(table(spark, d, "ssc_preds").where("label IS NOT NULL"), "label").withColumn("weight", F.round("weight", 6))


@query("WITH n AS (SELECT kind AS label, min(doc_id) AS f, count(*) AS n FROM documents WHERE kind IS NOT NULL GROUP BY 1) SELECT label, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS id, n FROM n")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return ds.label_ids(table(spark, d, "documents").where("kind IS NOT NULL"), "kind", "doc_id")


@query(f"{_GT} SELECT round(avg(CASE WHEN gt = CASE WHEN gt = 7 THEN 7 ELSE pred END THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM g")
def pseudo_fix_caption(spark: SparkSession, d: str) -> DataFrame:
    fixed = _gt(spark, d).withColumn("pred", F.when(F.col("gt") == 7, F.lit(7)).otherwise(F.col("pred")))
    return mt.accuracy(mt.confusion(fixed)).select(F.round("accuracy", 6).alias("accuracy"))


@query(f"{_GT} SELECT vec_id, gt, coalesce(pred, 0) AS pred FROM g")
def fill_missing_prediction(spark: SparkSession, d: str) -> DataFrame:
    g = _gt(spark, d)
    return g.select("vec_id", "gt").join(g.where("pred IS NOT NULL").select("vec_id", "pred"), "vec_id", "left").fillna(0, ["pred"])


@query(f"""{v.LAYOUT}, gt AS (SELECT {"record_id, page_pos"}, token_id, coalesce(type, 'paragraph') AS gt FROM tokens WHERE type IS NOT NULL),
b AS (SELECT record_id, page_pos, block_id, type FROM blocks),
one AS (SELECT record_id, page_pos, token_id, type AS pred FROM tokens WHERE text IS NOT NULL AND length(text) % 3 <> 0),
two AS (SELECT t.record_id, t.page_pos, t.token_id, b.type AS pred FROM tokens t JOIN b ON b.record_id = t.record_id AND b.page_pos = t.page_pos AND b.block_id = t.parent)
SELECT gt.record_id, gt.page_pos, gt.token_id, gt.gt, 'token' AS predictor, coalesce(one.pred, 'paragraph') AS pred FROM gt LEFT JOIN one USING (record_id, page_pos, token_id)
UNION ALL SELECT gt.record_id, gt.page_pos, gt.token_id, gt.gt, 'block', coalesce(two.pred, 'paragraph') FROM gt LEFT JOIN two USING (record_id, page_pos, token_id)""")
def truth_and_predictors(spark: SparkSession, d: str) -> DataFrame:
    """Ground truth of all pages beside two predictors: tokens by their own type, tokens by their block's type."""
    tokens, blocks = canonical.tokens(spark, d), canonical.blocks(spark, d)
    one = tokens.where("text IS NOT NULL AND char_length(text) % 3 <> 0").select(*gm.PAGE, "token_id", F.col("type").alias("pred"))
    two = tokens.join(blocks.select(*gm.PAGE, F.col("block_id").alias("parent"), F.col("type").alias("pred")), [*gm.PAGE, "parent"]).select(*gm.PAGE, "token_id", "pred")
    gt = tokens.where("type IS NOT NULL").select(*gm.PAGE, "token_id", F.col("type").alias("gt"))
    return mt.beside_truth(gt, {"token": one, "block": two}, [*gm.PAGE, "token_id"], "paragraph")


@query(f"{_GT} SELECT vec_id, gt, pred FROM g WHERE gt IS NOT NULL AND pred IS NOT NULL")
def join_truth_prediction(spark: SparkSession, d: str) -> DataFrame:
    g = _gt(spark, d)
    return g.where("gt IS NOT NULL").select("vec_id", "gt").join(g.where("pred IS NOT NULL").select("vec_id", "pred"), "vec_id")


@query("WITH p AS (SELECT kind, CASE WHEN text IS NOT NULL AND length(text) > 0 THEN 1 ELSE 0 END AS ok FROM documents) SELECT kind, round(avg(ok), 6) AS rate, CAST(sum(ok) AS BIGINT) AS done FROM p GROUP BY kind")
def success_rate(spark: SparkSession, d: str) -> DataFrame:
    ok = F.when(F.col("text").isNotNull() & (F.char_length("text") > 0), 1).otherwise(0)
    return table(spark, d, "documents").groupBy("kind").agg(F.round(F.avg(ok), 6).alias("rate"), F.sum(ok).cast("long").alias("done"))


def _rouge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ssc_input").where("size(sentences) > 1").select("input_id", "scope", F.get("sentences", 0).alias("candidate"), F.slice("sentences", 2, 1 << 30).alias("refs"))
    return mt.rouge_l(rows, ["input_id", "scope"], "candidate", "refs")


@query()
def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return _rouge(spark, d)


@query()
def rouge_corpus(spark: SparkSession, d: str) -> DataFrame:
    return _rouge(spark, d).groupBy("scope").agg(F.round(F.avg("rouge"), 6).alias("rouge"), F.count("*").alias("n"))


@query()
def rouge_top10(spark: SparkSession, d: str) -> DataFrame:
    r = _rouge(spark, d).join(table(spark, d, "ssc_input").select("input_id", "paper_id"), "input_id").where("paper_id IS NOT NULL")
    means = r.groupBy("paper_id").agg(F.round(F.avg("rouge"), 6).alias("rouge"))
    return means.orderBy(F.col("rouge").desc(), "paper_id").limit(10)


@query(f"{v.PREDS} SELECT paper_id, sentence, arg_max(block_id, pred_id) AS block_id FROM preds GROUP BY 1, 2")
def last_wins_blocks(spark: SparkSession, d: str) -> DataFrame:
    return canonical.predictions(spark, d).groupBy("paper_id", "sentence").agg(F.max_by("block_id", "pred_id").alias("block_id"))


@query(f"""{v.LAYOUT}, {_HIT}, {_DETECTED}, h AS (SELECT record_id, page_pos, token_id, min(block_id) AS parent FROM hits GROUP BY ALL),
c AS (SELECT record_id, page_pos, parent, type, count(*) AS n, min(token_id) AS f FROM d JOIN h USING (record_id, page_pos, token_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY record_id, page_pos, parent ORDER BY n DESC, f) AS rn FROM c)
SELECT b.record_id, b.page_pos, b.block_id, CASE WHEN b.type IN ('text', 'title', 'list') THEN r.type ELSE b.type END AS type FROM blocks b LEFT JOIN r ON r.record_id = b.record_id AND r.page_pos = b.page_pos AND r.parent = b.block_id AND r.rn = 1""")
def detected_layout(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of two detectors with their tokens' voted type, from the stand-in token scorer."""
    tokens, blocks = canonical.tokens(spark, d), canonical.blocks(spark, d)
    scored = sc.detect_tokens(tokens).select("record_id", "page_pos", "token_id", "type")
    placed = scored.join(gm.assign(tokens, blocks).withColumnRenamed("block_id", "parent"), ["record_id", "page_pos", "token_id"])
    return lo.vote_textual(blocks, placed)


# ---- sequences -----------------------------------------------------------------------------------


@query("""WITH RECURSIVE s AS (SELECT input_id, sentences, 0 AS lo, CAST(len(sentences) AS INTEGER) AS n FROM ssc_input WHERE sentences IS NOT NULL),
h AS (SELECT * FROM s UNION ALL SELECT input_id, sentences, CASE WHEN b = 0 THEN lo ELSE lo + n // 2 END, CASE WHEN b = 0 THEN n // 2 ELSE n - n // 2 END FROM h, (SELECT unnest([0, 1]) AS b) WHERE n > 10)
SELECT input_id, CAST(row_number() OVER (PARTITION BY input_id ORDER BY lo) - 1 AS INTEGER) AS part, array_to_string(sentences[lo + 1 : lo + n], '|') AS items FROM h WHERE n <= 10""")
def halve_sequences(spark: SparkSession, d: str) -> DataFrame:
    return sq.halve(table(spark, d, "ssc_input").where("sentences IS NOT NULL"), ["input_id"], "sentences", 10).select("input_id", "part", F.array_join("items", "|").alias("items"))


@query(r"SELECT input_id, array_to_string(list_transform(list_filter(sentences, lambda x: x IS NOT NULL), lambda s: array_to_string(regexp_split_to_array(s, '\s+')[1:100], ' ')), ' [SEP] ') AS text FROM ssc_input WHERE sentences IS NOT NULL")
def truncate_sep_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ssc_input").where("sentences IS NOT NULL")
    return rows.select("input_id", sq.join_truncated(F.filter("sentences", lambda s: s.isNotNull()), 100).alias("text"))


_PIECES = """WITH _w AS (SELECT doc_id, regexp_extract_all(text, '[^\\s\\x0b]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(range(len(ws))) AS word, unnest(ws) AS token FROM _w),
_q AS (SELECT doc_id, word, regexp_extract_all(token, '.{1,4}') AS ps FROM words),
_r AS (SELECT doc_id, word, unnest(range(len(ps))) AS piece_no, unnest(ps) AS piece FROM _q),
pieces AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY word, piece_no) - 1 AS pos FROM _r)"""


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return sq.subtokens(table(spark, d, "documents"), "doc_id")


@query(f"{_PIECES} SELECT doc_id, CAST(pos // 510 AS INTEGER) AS win, count(*) AS length, min(word) AS first_word, sum(CASE WHEN piece_no = 0 THEN 1 ELSE 0 END) AS labels FROM pieces GROUP BY 1, 2")
def window_pack_510(spark: SparkSession, d: str) -> DataFrame:
    w = sq.windows(_pieces(spark, d), "doc_id")
    return w.select("doc_id", "win", "length", "first_word", F.size(F.filter(sq.padded(F.col("labels")), lambda x: x >= 0)).alias("labels"))


@query(f"{_PIECES} SELECT doc_id, word, arg_min(length(piece), pos) AS first_length FROM pieces GROUP BY 1, 2")
def first_subtoken_vote(spark: SparkSession, d: str) -> DataFrame:
    return sq.first_piece(_pieces(spark, d).withColumn("first_length", F.char_length("piece")), "doc_id", "first_length")


@query(f"{_PIECES} SELECT doc_id, pos, CAST(sum(CASE WHEN piece_no = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS word_no FROM pieces")
def offset_word_map(spark: SparkSession, d: str) -> DataFrame:
    return sq.word_of_offset(_pieces(spark, d), "doc_id").select("doc_id", "pos", F.col("word_no").cast("long").alias("word_no"))


_LONG = "WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\\s\\x0b]+') AS ws FROM documents WHERE text IS NOT NULL)"


@query(f"{_LONG} SELECT doc_id, CAST(CASE WHEN len(ws) > 752 AND doc_id % 2 = 1 THEN 240 ELSE 0 END AS INTEGER) AS start, CAST(CASE WHEN len(ws) > 752 AND doc_id % 2 = 1 THEN len(ws) - 512 ELSE 0 END AS INTEGER) AS tail_start FROM w")
def long_page_start(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0)))
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", n.alias("n"))
    return rows.select("doc_id", sq.long_start(F.col("n"), F.col("doc_id")).alias("start"), sq.long_start(F.col("n"), F.col("doc_id"), other=F.col("n") - 512).alias("tail_start"))


# ---- data sets -----------------------------------------------------------------------------------


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('452' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN k < floor(n * 0.7) THEN 'train' WHEN k < floor(n * 0.7) + floor(n * 0.15) THEN 'dev' ELSE 'test' END AS part FROM r""")
def split_70_15_15(spark: SparkSession, d: str) -> DataFrame:
    return ds.split(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('452' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS k, count(*) OVER () AS n FROM documents),
s AS (SELECT doc_id, CASE WHEN k < floor(n * 0.7) THEN 'train' WHEN k < floor(n * 0.7) + floor(n * 0.15) THEN 'dev' ELSE 'test' END AS part FROM r)
SELECT d.doc_id, 'doc_' || d.doc_id AS savename, d.kind, s.part FROM documents d LEFT JOIN s USING (doc_id)""")
def subset_of_savename(spark: SparkSession, d: str) -> DataFrame:
    """The subset of each item by its saved name."""
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("savename")
    docs = table(spark, d, "documents")
    parts = ds.split(docs.select("doc_id"), "doc_id").select(name, "part")
    return docs.select("doc_id", name, "kind").join(parts, "savename", "left").select("doc_id", "savename", "kind", "part")


@query("SELECT doc_id FROM documents ORDER BY md5('s' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def sample_n(spark: SparkSession, d: str) -> DataFrame:
    return ds.sample_n(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) WHERE k % 20 = 0")
def every_20th(spark: SparkSession, d: str) -> DataFrame:
    return ds.every_nth(table(spark, d, "documents").select("doc_id"), "doc_id", 20)


@query("SELECT input_id FROM (SELECT input_id FROM ssc_input WHERE sentences IS NULL OR len(sentences) = 0 UNION SELECT input_id FROM ssc_input WHERE paper_id IS NULL)")
def error_indices(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ssc_input")
    return rows.where("sentences IS NULL OR size(sentences) = 0").select("input_id").union(rows.where("paper_id IS NULL").select("input_id")).distinct()


@query("SELECT id, paper_id FROM papers WHERE paper_id NOT IN (SELECT paper_id FROM ssc_preds WHERE paper_id IS NOT NULL)")
def papers_to_process(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "ssc_preds").select("paper_id").distinct()
    return table(spark, d, "papers").select("id", "paper_id").join(done, "paper_id", "left_anti").select("id", "paper_id")


# ---- scorers and streams -------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT input_id, unnest(range(len(sentences))) AS pos, unnest(sentences) AS sentence FROM ssc_input),
e AS (SELECT input_id, pos, sentence, [{_SOFT}] AS e FROM s WHERE sentence IS NOT NULL),
p AS (SELECT input_id, pos, sentence, list_transform(e, lambda x: round(x / list_sum(e), 12)) AS scores FROM e)
SELECT input_id, CAST(row_number() OVER (PARTITION BY input_id ORDER BY scores DESC, pos) - 1 AS INTEGER) AS rank, sentence, ['Background', 'Objective', 'Method', 'Result', 'Other'][list_position(scores, list_max(scores))] AS label, round(list_max(scores), 6) AS prob FROM p""")
def classify_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sc.classify_sentences(table(spark, d, "ssc_input"))


@query(f"{v.LAYOUT}, {_DETECTED} SELECT * FROM d")
def detect_tokens(spark: SparkSession, d: str) -> DataFrame:
    return sc.detect_tokens(canonical.tokens(spark, d))


_INTER = "greatest(0, least(q.x2, r.x2) - greatest(q.x1, r.x1)) * greatest(0, least(q.y2, r.y2) - greatest(q.y1, r.y1))"
_CLEAR = f"len(list_filter(h.kept, lambda q: {_INTER} > 0.4 * ((q.x2 - q.x1) * (q.y2 - q.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - {_INTER}))) = 0"
_ITEM = "{'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}"


@query(f"""{v.LAYOUT.replace("WITH", "WITH RECURSIVE", 1)}, r AS (SELECT *, row_number() OVER (PARTITION BY record_id, page_pos ORDER BY confidence DESC, block_id) AS k FROM blocks WHERE confidence >= 0.55),
h AS (SELECT r.record_id, r.page_pos, r.k, true AS keep, [{_ITEM}] AS kept FROM r WHERE k = 1
  UNION ALL SELECT r.record_id, r.page_pos, r.k, {_CLEAR}, CASE WHEN {_CLEAR} THEN list_append(h.kept, {_ITEM}) ELSE h.kept END FROM h JOIN r ON r.record_id = h.record_id AND r.page_pos = h.page_pos AND r.k = h.k + 1)
SELECT r.record_id, r.page_pos, r.block_id, r.type, r.x1, r.y1, r.x2, r.y2, r.confidence AS score FROM r JOIN h ON h.record_id = r.record_id AND h.page_pos = r.page_pos AND h.k = r.k WHERE h.keep""")
def suppress_blocks(spark: SparkSession, d: str) -> DataFrame:
    return sc.suppress(canonical.blocks(spark, d).withColumnRenamed("confidence", "score"))


@query()
def author_clauses(spark: SparkSession, d: str) -> DataFrame:
    return sc.condense_clauses(canonical.doc_sentences(spark, d))


@query()
def calibrated_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.get("embedding", 0).cast("double").alias("score"), (F.col("label") % 2).cast("double").alias("hit"))
    return sc.calibrate(rows).transform(_assembled(rows)).select("vec_id", F.round("calibrated", 6).alias("calibrated"))


def _assembled(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=["score"], outputCol="_f").transform(rows)


@query(SQL_FACETS)
def stream_facets(spark: SparkSession, d: str) -> DataFrame:
    """All facets by the file stream: what has arrived is processed once and read back."""
    home = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    sections = table(spark, d, "sections")
    # a pattern, since the table may be one file or a folder of them
    stream = fs.section_stream(spark, f"{d}/sections.parque[t]", sections.schema)
    fs.run_available(stream, f"{home}/out", f"{home}/state")
    return spark.read.parquet(f"{home}/out").groupBy("label").agg(F.count("*").alias("n"))
