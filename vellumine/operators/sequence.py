"""Sequences for models: halving, truncation, fixed windows and the way back from subtokens to words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.operators.segment import WORD, running_ends
from vellumine.session import spread


def halves(n: int, most: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the leaves of recursive halving while a part is longer than ``most``."""
    if most <= 0 or n <= most:
        return [(0, n)]
    mid = n // 2
    return halves(mid, most) + [(mid + a, m) for a, m in halves(n - mid, most)]


def _levels(most: int, longest: int) -> int:
    depth = 0
    while longest > most:
        longest = -(-longest // 2)
        depth += 1
    return depth


def halve(rows: DataFrame, keys: list[str], array: str, most: int, longest: int = 1 << 31) -> DataFrame:
    """Rows ``(keys, part, items)`` of arrays halved until each has at most ``most`` items, in order.

    A part is a pair of start and length; every level maps the list of parts to their halves, as many
    levels as an array of ``longest`` items needs.
    """
    parts: Column = F.array(F.struct(F.lit(0).alias("s"), F.size(array).alias("n")))
    for _ in range(_levels(most, longest)):
        parts = F.flatten(F.transform(parts, lambda p: F.when(p["n"] <= most, F.array(p)).otherwise(F.array(
            F.struct(p["s"].alias("s"), F.floor(p["n"] / 2).cast("int").alias("n")),
            F.struct((p["s"] + F.floor(p["n"] / 2)).cast("int").alias("s"), (p["n"] - F.floor(p["n"] / 2)).cast("int").alias("n"))))))
    cut = rows.select(*keys, array, F.posexplode(parts).alias("part", "p"))
    return cut.select(*keys, "part", F.slice(F.col(array), F.col("p.s") + 1, F.col("p.n")).alias("items"))


def join_truncated(sentences: Column, most: int, sep: str = " [SEP] ") -> Column:
    """Sentences cut to ``most`` words each and joined by a separator."""
    return F.array_join(F.transform(sentences, lambda s: F.array_join(F.slice(F.split(s, r"\s+"), 1, most), " ")), sep)


def subtokens(df: DataFrame, key: str, text: str = "text", width: int = 4) -> DataFrame:
    """A deterministic stand-in tokenizer: pieces of ``width`` characters, ``(key, word, piece_no, piece, pos)``.

    Places are running sums inside the row, so nothing is shuffled.
    """
    rows = spread(df.select(key, text), key).select(key, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"))
    rows = rows.withColumn("_e", running_ends(F.transform("_w", lambda w: F.ceil(F.char_length(w) / width).cast("int"))))
    words = rows.select(key, F.posexplode(F.arrays_zip("_w", "_e")).alias("word", "x"))
    pieces = F.regexp_extract_all("x._w", F.lit(f".{{1,{width}}}"), F.lit(0))
    out = words.select(key, "word", F.col("x._e").alias("_e"), F.size(pieces).alias("_n"), F.posexplode(pieces).alias("piece_no", "piece"))
    return out.select(key, "word", "piece_no", "piece", (F.col("_e") - F.col("_n") + F.col("piece_no")).alias("pos"))


def windows(pieces: DataFrame, key: str, size: int = 510) -> DataFrame:
    """Fixed windows ``(key, win, length, first_word, labels)``; only a word's first piece carries its label."""
    w = pieces.withColumn("win", F.floor(F.col("pos") / size).cast("int"))
    label = F.when(F.col("piece_no") == 0, F.col("word")).otherwise(-1)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", label.alias("l")))), lambda s: s["l"])
    return w.groupBy(key, "win").agg(F.count("*").alias("length"), F.min("word").alias("first_word"), ordered.alias("labels"))


def padded(labels: Column, size: int = 512, pad: int = -1) -> Column:
    """Labels with the ignored value at both ends and up to the window's full width."""
    return F.concat(F.array(F.lit(pad)), labels, F.array_repeat(F.lit(pad), size - 1 - F.size(labels)))


def boxed_windows(tokens: DataFrame, keys: list[str], label: str, boxes: list[str], size: int = 512, width: int = 4) -> DataFrame:
    """Model windows of each page: ``(keys, win, labels, mask, <boxes>)``, every array ``size`` long.

    A token's pieces share its box, and only the first carries its label; the other places have -1. A window
    opens with a start mark (box 0), closes with an end mark (box 1000) and is filled up (box 0, mask 0).
    A page's tokens, which are bounded, are gathered into one row and cut inside it.
    """
    page = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("token_id", "text", F.col(label).alias("label"), *boxes))).alias("t"))
    piece = lambda t: F.transform(F.regexp_extract_all(t["text"], F.lit(f".{{1,{width}}}"), F.lit(0)), lambda p, i: F.struct(F.when(i == 0, t["label"]).otherwise(-1).alias("label"), *[t[b].alias(b) for b in boxes]))
    page = page.select(*keys, F.flatten(F.transform("t", piece)).alias("p")).where(F.size("p") > 0)
    inner = size - 2
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("p") - 1) / inner).cast("int")), lambda w: F.slice(F.col("p"), w * inner + 1, inner))
    win = page.select(*keys, F.posexplode(cut).alias("win", "w"))
    gap = inner - F.size("w")

    def filled(values: Column, start: int, end: int, pad: int) -> Column:
        return F.concat(F.array(F.lit(start)), values, F.array(F.lit(end)), F.array_repeat(F.lit(pad), gap))

    return win.select(*keys, "win", filled(F.col("w.label"), -1, -1, -1).alias("labels"), filled(F.transform("w", lambda x: F.lit(1)), 1, 1, 0).alias("mask"),
                      *[filled(F.col(f"w.{b}"), 0, 1000, 0).alias(b) for b in boxes])


def first_piece(pieces: DataFrame, key: str, value: str) -> DataFrame:
    """Back to words: the value of a word's first piece."""
    return pieces.groupBy(key, "word").agg(F.min_by(value, "pos").alias(value))


def word_of_offset(pieces: DataFrame, key: str) -> DataFrame:
    """Number of the word of each piece, from where offsets start over."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return pieces.withColumn("word_no", F.sum(F.when(F.col("piece_no") == 0, 1).otherwise(0)).over(w) - 1)


def long_start(n: Column, seed: Column, longest: int = 752, other: Column | None = None) -> Column:
    """Start of the slice of a long page: 0 or ``other`` (by default 240), by a hash of its key."""
    far = F.lit(240) if other is None else other
    return F.when((n > longest) & (F.pmod(seed, F.lit(2)) == 1), far).otherwise(F.lit(0)).cast("int")
