"""Interfaces for models, with checked schemas, and deterministic stand-ins that need no model.

A scorer is a function over batches (``Iterator[pandas.DataFrame]``); it never sees the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumine.operators import rank as rk
from vellumine.operators.geometry import PAGE

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

BLOCK_SCHEMA = "record_id long, page_pos int, type string, x1 double, y1 double, x2 double, y2 double, score double"
TOKEN_SCHEMA = "record_id long, page_pos int, token_id int, type string, score double"
SSC_SCHEMA = "input_id long, pos int, sentence string, scores array<double>"
#: Order of the sentence classes in a score vector (fixed values).
CLASSES = ("Background", "Objective", "Method", "Result", "Other")


def _unit(text: str, k: int) -> float:
    return int.from_bytes(md5(f"{k}:{text}".encode()).digest()[:6], "big") / 2**48


def apply(rows: DataFrame, scorer: Scorer, schema: str, needs: tuple[str, ...]) -> DataFrame:
    """Run a scorer on the columns it needs; Spark checks what it returns against the schema."""
    missing = set(needs) - set(rows.columns)
    if missing:
        raise ValueError(f"the scorer needs {sorted(missing)}")
    return rows.select(*needs).mapInPandas(scorer, schema)


def tolerant(scorer: Scorer, keys: tuple[str, ...], empty: dict[str, object]) -> Scorer:
    """A scorer whose errors give rows with the item's ``keys`` and ``empty`` values instead of ending the job.

    A batch that fails is asked again item by item, so only the items that cause the error are without an answer.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                yield from list(scorer(iter([pdf])))
            except Exception:
                for k in range(len(pdf)):
                    one = pdf.iloc[k : k + 1]
                    try:
                        yield from list(scorer(iter([one])))
                    except Exception:
                        yield one[list(keys)].assign(**{name: [value] for name, value in empty.items()})

    return run


def stub_sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Softmax scores from a hash of each sentence."""
    for pdf in batches:
        rows = []
        for input_id, pos, s in pdf.itertuples(index=False):
            x = np.exp([4 * _unit(s or "", k) for k in range(len(CLASSES))])
            rows.append((input_id, pos, s, (x / x.sum()).tolist()))
        yield pd.DataFrame(rows, columns=["input_id", "pos", "sentence", "scores"])


def classify_sentences(ssc_input: DataFrame, scorer: Scorer = stub_sentences) -> DataFrame:
    """``(input_id, rank, sentence, label, prob)``: best class of each sentence, ordered by the score vectors.

    Null sentences take no part; an item without sentences gives no rows; a sentence for which the scorer
    fails has neither label nor probability and comes last.
    """
    scorer = tolerant(scorer, ("input_id", "pos", "sentence"), {"scores": None})
    rows = ssc_input.select("input_id", F.posexplode("sentences").alias("pos", "sentence")).where("sentence IS NOT NULL")
    s = apply(rows, scorer, SSC_SCHEMA, ("input_id", "pos", "sentence"))
    names = F.array(*[F.lit(c) for c in CLASSES])
    w = Window.partitionBy("input_id").orderBy(F.col("scores").desc_nulls_last(), "pos")
    return s.select("input_id", (F.row_number().over(w) - 1).alias("rank"), "sentence", F.get(names, rk.argmax(F.col("scores"))).alias("label"), F.round(F.array_max("scores"), 6).alias("prob"))


def stub_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A token type from a hash of its text."""
    kinds = ("paragraph", "title", "list", "caption")
    for pdf in batches:
        rows = [(r, p, t, kinds[int(_unit(x, 0) * len(kinds))], _unit(x, 1)) for r, p, t, x in pdf.itertuples(index=False)]
        yield pd.DataFrame(rows, columns=["record_id", "page_pos", "token_id", "type", "score"])


def detect_tokens(tokens: DataFrame, scorer: Scorer = stub_tokens) -> DataFrame:
    """Type and score of each token; empty texts aren't scored."""
    rows = tokens.where("text IS NOT NULL AND text <> ''").select(*PAGE, "token_id", "text")
    return apply(rows, scorer, TOKEN_SCHEMA, (*PAGE, "token_id", "text"))


def suppress(blocks: DataFrame, least: float = 0.55, overlap: float = 0.4) -> DataFrame:
    """Blocks above a score without those a better one of their page overlaps too much.

    A page's blocks are few, so a page is handled as a whole.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "block_id"], ascending=[False, True])
        kept: list[int] = []
        b = pdf[["x1", "y1", "x2", "y2"]].to_numpy()
        area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        for i in range(len(b)):
            for j in kept:
                w = min(b[i, 2], b[j, 2]) - max(b[i, 0], b[j, 0])
                h = min(b[i, 3], b[j, 3]) - max(b[i, 1], b[j, 1])
                inter = max(0.0, w) * max(0.0, h)
                if inter > overlap * (area[i] + area[j] - inter):
                    break
            else:
                kept.append(i)
        return pdf.iloc[kept]

    rows = blocks.where(F.col("score") >= least).select(*PAGE, "block_id", "type", "x1", "y1", "x2", "y2", "score")
    return rows.groupBy(*PAGE).applyInPandas(keep, rows.schema)


def stub_tagger(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Part of speech by word lists and endings: PRON, VERB, SCONJ, NOUN and OTHER."""
    verbs = ("present", "propose", "show", "find", "use", "describe", "introduce", "evaluate", "examine", "compare", "extend", "annotated", "observed", "conclude", "investigate")
    small = ("the", "a", "an", "of", "to", "in", "on", "for", "with", "by", "and", "or", "at", "from")

    def tag(w: str) -> str:
        low = w.lower().strip(".,;:!?")
        if low in ("we", "our"):
            return "PRON"
        if low == "that":
            return "SCONJ"
        if low.rstrip("sd").rstrip("e") in {v.rstrip("d").rstrip("e") for v in verbs}:
            return "VERB"
        return "OTHER" if low in small[2:] or not low[:1].isalnum() else "NOUN"

    for pdf in batches:
        pdf["tags"] = [[tag(w) for w in (ws if ws is not None else [])] for ws in pdf["words"]]
        yield pdf


def condense_clauses(sentences: DataFrame, tagger: Scorer = stub_tagger) -> DataFrame:
    """``(doc_id, sent_id, clause)``: from "we" on to the end of the noun phrase after the verb; "that" goes on once more.

    The automaton runs in the JVM over tagged words: state 0 before the pronoun, 1 after it, 2 after the verb,
    3 inside a noun phrase, 4 done. A sentence without a complete clause gives no row.
    """
    rows = sentences.select("doc_id", "sent_id", F.split("text", r"\s+").alias("words"))
    tagged = rows.mapInPandas(tagger, "doc_id long, sent_id int, words array<string>, tags array<string>")
    pairs = F.arrays_zip("words", "tags")
    start = F.struct(F.lit(0).alias("state"), F.lit(False).alias("again"), F.array().cast("array<string>").alias("out"))

    def step(s, p):
        tag, state, noun = p["tags"], s["state"], p["tags"].isin("NOUN", "PRON")
        again = F.when(tag == "SCONJ", F.lit(True)).when((state == 3) & ~noun, F.lit(False)).otherwise(s["again"])
        new = (F.when(state == 4, 4).when((state == 0) & (tag == "PRON"), 1).when(state == 0, 0)
               .when(tag == "VERB", F.when(state == 3, 3).otherwise(2)).when((state == 2) & noun, 3)
               .when((state == 3) & ~noun & (tag != "SCONJ") & ~s["again"], 4).when((state == 3) & ~noun & (tag != "SCONJ"), 2).otherwise(state))
        out = F.when((new > 0) & (new < 4), F.concat(s["out"], F.array(p["words"]))).otherwise(s["out"])
        return F.struct(new.alias("state"), again.alias("again"), out.alias("out"))

    done = tagged.select("doc_id", "sent_id", F.aggregate(pairs, start, step).alias("s"))
    return done.where("s.state IN (3, 4)").select("doc_id", "sent_id", F.array_join("s.out", " ").alias("clause"))


def calibrate(rows: DataFrame, score: str = "score", hit: str = "hit", most_rows: int = 1_000_000):
    """Isotonic calibration of scores to hit rates; returns the fitted model of MLlib.

    The fit pools its points in the driver, so of more than ``most_rows`` labelled rows about that many, by a
    hash of the score, are taken.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    rows = rows.where(F.col(score).isNotNull() & F.col(hit).isNotNull())
    total = rows.count()
    if total > most_rows:
        rows = rows.where(F.pmod(F.xxhash64(score, hit), F.lit(total)) < most_rows)
    data = VectorAssembler(inputCols=[score], outputCol="_f").transform(rows)
    return IsotonicRegression(featuresCol="_f", labelCol=hit, predictionCol="calibrated").fit(data)
