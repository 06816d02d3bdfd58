"""Problem 3: text statistics of bodies and headers, and the tails of their distributions.

Each statistic of each language goes into a mergeable quantile sketch:
counts over fixed cells (relative width 2 %, exact near 0), so sketches add up in any order and the
result doesn't depend on the partitioning. A value becomes a robust z-score against
its language, and the tails of the z-scores alone tell prose and headings from lists, tables and junk:
a verdict follows when the distribution of its language shifts. What a verdict needs besides is the
number of lines: lists and tables have one entry or row a line, so two lines or more.

Sketches have at most 700 cells a statistic and language; languages are detected from the text itself
(scripts and common words), so their number is fixed and the lookup table is small.

Defined results: null, empty and blank values give no row; repeated rows count each; an empty table
gives no rows; the given language isn't trusted; very long texts cost time in proportion to their
length; extra columns aren't read. A header that numbers a table or figure heads the section that
holds it, so it is a heading.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.session import materialise, spread

#: Statistics with the smallest scale of their z-score.
STATS = {
    "word_count": 5.0, "mean_word": 0.5, "longest_word": 4.0, "symbol_share": 0.02, "letter_share": 0.05, "punct_lines": 0.1, "stop_rate": 0.2,
    "common_share": 0.03, "cell_share": 0.04, "marker_lines": 0.1, "line_words": 2.0, "line_fill": 0.06, "top_share": 0.05, "lone_letters": 0.1,
}
TAIL = 3.0
_MARK = re.compile(r"^[ \t]*(?:\(\d{1,3}\)|\d{1,3}[.)]|\([a-zA-Z]\)|[a-zA-Z]\)|\[\d{1,3}\]|[-–—•*·‣▪])[ \t]+\S")
_CELL = re.compile(r"(?:[-–—]|n/a|[<>=±~≈]|[-−+]?\d[\d.,]*(?:e-?\d+)?%?)[|&,]?")
_END = re.compile(r"[.!?。！？।؟…:;；：;][\"'”’»)\]」』]*(?:\[[\d, –-]+\])*$")
_ORDINARY = frozenset(".,;:!?'\"()[]{}-–—…。，、！？；：“”‘’«»„।؟،؛「」『』（）〈〉《》¿¡;·")
_SCRIPTS = (
    ("ja", re.compile("[\u3040-\u30ff]"), 0.08), ("zh", re.compile("[\u3400-\u9fff]"), 0.3), ("th", re.compile("[\u0e00-\u0e7f]"), 0.3),
    ("ar", re.compile("[\u0600-\u06ff]"), 0.3), ("hi", re.compile("[\u0900-\u097f]"), 0.3), ("el", re.compile("[\u0370-\u03ff\u1f00-\u1fff]"), 0.3),
)
UNSPACED = ("zh", "ja", "th")
SCHEMA = "section_id long, place string, language string, lines double, " + ", ".join(f"{s} double" for s in STATS)


def common_words(common: DataFrame) -> dict[str, frozenset[str]]:
    """The fixed word list by language."""
    words: dict[str, set[str]] = {}
    for r in common.where("lang IS NOT NULL AND word IS NOT NULL").select("lang", "word").collect():
        words.setdefault(r["lang"], set()).add(r["word"].lower())
    return {k: frozenset(v) for k, v in words.items()}


def _language(text: str, tokens: list[str], letters: int, common: dict[str, frozenset[str]]) -> tuple[str, float]:
    """Detected language and hits of its common words; a script decides where it can, else most hits."""
    if not text.isascii():
        for code, pattern, least in _SCRIPTS:
            if sum(1 for _ in pattern.finditer(text)) >= least * max(1, letters):
                words = common.get(code, frozenset())
                if code in UNSPACED:
                    return code, float(sum(text.count(w) for w in words))
                return code, float(sum(t in words for t in tokens))
    best = ("en", 0.0)
    for code, words in common.items():
        if code not in ("zh", "ja", "th", "ar", "hi", "el"):
            hits = float(sum(t in words for t in tokens))
            if hits > best[1]:
                best = (code, hits)
    return best


def measure(text: str, common: dict[str, frozenset[str]]) -> tuple:
    """All statistics of one text that isn't blank, in the order of ``SCHEMA`` after ``place``."""
    words = text.split()
    tokens = [w.strip(".,;:!?()\"'“”«»„।؟،").lower() for w in words]
    solid = sum(map(len, words))
    chars = Counter(text)
    letters = digits = plain = 0
    for c, n in chars.items():
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            letters += n
        elif c.isdigit():
            digits += n
        elif c in _ORDINARY:
            plain += n
    language, hits = _language(text, tokens, letters, common)
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    n, w = len(lines), len(words)
    spaced = language not in UNSPACED
    size = w if spaced else letters / 3
    widths = [len(x) for x in lines]
    ended = sum(_END.search(x) is not None for x in lines)
    most = Counter(words).most_common(1)[0][1]
    values = {
        "word_count": w, "mean_word": solid / w, "longest_word": max(map(len, words)), "symbol_share": (solid - letters - digits - plain) / solid,
        "letter_share": letters / solid, "punct_lines": ended / n, "stop_rate": min(1.0, (ended + len(_INNER.findall(text))) / max(1.0, size / 10)),
        "common_share": hits / max(1, w if spaced else letters), "cell_share": sum(_CELL.fullmatch(t) is not None for t in words) / w,
        "marker_lines": sum(_MARK.match(x) is not None for x in lines) / n, "line_words": size / n,
        "line_fill": sum(v >= 0.72 * max(widths) for v in widths[:-1]) / (n - 1) if n > 1 else 1.0, "top_share": (most - 1) / w,
        "lone_letters": max(0, sum(len(x) == 1 and x.isalpha() for x in words) - 1) / w,
    }
    return language, float(n), *(float(values[s]) for s in STATS)


_INNER = re.compile(r"[.!?][\"'”’»)\]]*\s+[^\W\d_]|[。！？।؟]")


def statistics(values: DataFrame, common: dict[str, frozenset[str]]) -> DataFrame:
    """Statistics of ``(section_id, place, text)``; blank texts are left out; see ``SCHEMA``.

    One Arrow-batched pass measures everything: as JVM expressions the word and line functions would
    be evaluated over again for each statistic.
    """
    names = SCHEMA.replace(",", "").split()[::2]

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(i, p, *measure(t, common)) for i, p, t in pdf.itertuples(index=False) if t and not t.isspace()]
            yield pd.DataFrame(rows, columns=names)

    return spread(values.where("text IS NOT NULL AND text <> ''"), "section_id").mapInPandas(batches, SCHEMA)


def _cell(v: Column) -> Column:
    """Index of the sketch cell of a value of at least 0: exact at 0, then 2 % wide from 1e-4 on."""
    return F.when(v < 1e-4, F.lit(0)).otherwise((F.floor(F.log(v / 1e-4) / F.log(F.lit(1.02))) + 1).cast("int"))


def _middle(cell: Column) -> Column:
    return F.when(cell == 0, F.lit(0.0)).otherwise(F.lit(1e-4) * F.pow(F.lit(1.02), cell - 0.5))


def sketches(stats: DataFrame) -> DataFrame:
    """``(place, language, stat, cell, n)``: one mergeable sketch per statistic, place and language.

    Counts are combined before the shuffle; the result has a bounded size.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), _cell(F.col(s)).alias("cell")) for s in STATS])).alias("c")
    return stats.select("place", "language", cells).groupBy("place", "language", "c.stat", "c.cell").agg(F.count("*").alias("n"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sketches of a union of inputs, from the sketches of its parts."""
    return a.unionByName(b).groupBy("place", "language", "stat", "cell").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame) -> DataFrame:
    """Median, quartiles and size of each sketch."""
    w = Window.partitionBy("place", "language", "stat").orderBy("cell")
    all_of = Window.partitionBy("place", "language", "stat")
    ranked = sketch.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(all_of))

    def at(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= q * F.col("total"), _middle(F.col("cell"))))

    return ranked.groupBy("place", "language", "stat").agg(at(0.5).alias("median"), at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("total").alias("n"))


def scored(stats: DataFrame, sketch: DataFrame) -> DataFrame:
    """Statistics with a robust z-score of each against place and language."""
    one = quantiles(sketch).select("place", "language", "stat", F.struct("median", "q1", "q3").alias("_q"))
    table = one.groupBy("place", "language").agg(*[F.max(F.when(F.col("stat") == s, F.col("_q"))).alias(f"_{s}") for s in STATS])
    # 2 places x 10 languages, each with the quartiles of 14 statistics
    out = stats.join(F.broadcast(table), ["place", "language"])
    cols = []
    for s, least in STATS.items():
        q = F.col(f"_{s}")
        scale = F.greatest(F.lit(least), (q["q3"] - q["q1"]) / 1.349)
        cols.append(F.round((F.col(s) - q["median"]) / scale, 4).alias(f"z_{s}"))
    return out.select(*stats.columns, *cols)


def verdicts(scores: DataFrame) -> DataFrame:
    """``verdict`` of each scored value: ``list``, ``table``, ``junk`` or null for prose and headings.

    Every condition is a tail of z-scores, single or summed; only scripts without blanks, which have no
    words to measure, and the number of lines are looked at beside them.
    """
    spaced = ~F.col("language").isin(*UNSPACED)
    z = {s: F.col(f"z_{s}") for s in STATS}
    word = F.when(spaced, z["mean_word"]).otherwise(0.0)
    strange = z["common_share"] <= -TAIL / 2
    marked = (z["marker_lines"] >= 2.6 * TAIL) & (F.col("lines") >= 2)
    repeated = (z["top_share"] >= 4 * TAIL) & strange
    stacked = word <= -2.5 * TAIL
    cells = (z["cell_share"] >= 2 * TAIL) & (z["letter_share"] <= -TAIL) & (F.col("lines") >= 2)
    entry = z["stop_rate"] + z["line_fill"] + z["common_share"] - word + z["line_words"]
    terse = (z["stop_rate"] <= -1.3 * TAIL) & (z["common_share"] <= -0.8 * TAIL)
    bare = (((z["stop_rate"] <= -TAIL) & (entry <= -2.1 * TAIL)) | terse) & (z["letter_share"] > -2.5 * TAIL) & (z["symbol_share"] < 4 * TAIL) & (F.col("lines") >= 3)
    unreadable = strange & ((z["symbol_share"] >= 3 * TAIL) | (z["letter_share"] <= -2.5 * TAIL) | ((word >= 4 * TAIL) & (z["longest_word"] >= 2 * TAIL)))
    body = F.when(marked, "list").when(repeated | stacked, "junk").when(cells, "table").when(bare, "list").when(unreadable, "junk")
    no_heading = ((z["letter_share"] <= -0.6 * TAIL) & (z["letter_share"] + word <= -1.2 * TAIL)) | (z["letter_share"] <= -0.9 * TAIL) | (z["symbol_share"] >= TAIL) | (z["lone_letters"] >= TAIL)
    return scores.withColumn("verdict", F.when(F.col("place") == "body", body).when(no_heading, "junk"))


def judged(values: DataFrame, common: dict[str, frozenset[str]]) -> DataFrame:
    """Statistics, scores and verdict of every value; the texts are measured once and stored narrow."""
    stats = materialise(statistics(values, common))
    return verdicts(scored(stats, sketches(stats)))


def found(rows: DataFrame) -> DataFrame:
    return rows.where("verdict IS NOT NULL").select("section_id", "place", "verdict")


def values(sections: DataFrame) -> DataFrame:
    """Bodies and headers as ``(section_id, place, text)`` rows from one scan."""
    both = F.array(F.struct(F.lit("body").alias("place"), F.col("body").alias("text")), F.struct(F.lit("header").alias("place"), F.col("header").alias("text")))
    return sections.select("section_id", F.explode(both).alias("v")).select("section_id", "v.place", "v.text")
