"""Problem 2: cut oversized items at natural boundaries.

Dynamic programming over the boundary positions of an item chooses the cuts: it minimises the sum
of cut penalties (paragraph < sentence < clause < blank < none) and of the squared deviation from
even sizes, subject to a maximum length and to an exact overlap between neighbouring pieces.

Defined results: null and empty items and items within the limit give no rows (they need no cut);
repeated rows give their rows again; columns beyond those named aren't read. Where natural boundaries
lie further apart than a piece reaches beyond its overlap, any code point between them may be a cut
(``none`` inside a stretch longer than the limit, else ``overlap``). A piece is
``text[start:end]``; every piece but the first starts ``overlap`` code points before its
predecessor's end, so dropping that many characters from each later piece restores the item.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.session import spread

BODY_LIMIT, ELEMENT_LIMIT = 1800, 320
BODY_OVERLAP, ELEMENT_OVERLAP = 120, 24
#: Characters that end a stretch like white space does.
BREAKERS = "。！？；，、।؟"
PENALTY = {"paragraph": 0.0, "sentence": 0.15, "clause": 0.6, "blank": 1.2, "none": 30.0}
_STRETCH = re.compile(rf"[^\s{BREAKERS}]+")
_BREAK = re.compile(rf"[\s{BREAKERS}]")
_CUTS = (
    ("paragraph", re.compile(r"\n\s*")),
    ("sentence", re.compile(r"(?:(?<![.!?…])[.!?…]+[\"'”’»)\]]*(?=\s))|[。！？।؟][”’」』）»]*")),
    ("clause", re.compile(r"[,;:](?=\s)|[；，、]")),
    ("blank", re.compile(r"\s+")),
)


def longest_stretch(text: str) -> int:
    """Length of the longest run without white space and without a breaker."""
    return max((m.end() - m.start() for m in _STRETCH.finditer(text)), default=0)


def boundaries(text: str, step: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Natural cut positions (a piece may end there) with the penalty of each.

    A blank is cut behind; where a stretch with its blank is longer than ``step``, also before.
    """
    best: dict[int, float] = {}
    left = 0
    for kind, pattern in _CUTS:
        cost = PENALTY[kind]
        for m in pattern.finditer(text):
            if 0 < m.end() < len(text):
                best.setdefault(m.end(), cost)
            if kind == "blank":
                if step is not None and m.start() > 0 and m.end() - left > step:
                    best.setdefault(m.start(), cost)
                left = m.end()
    at = np.fromiter(sorted(best), dtype=np.int64, count=len(best))
    return at, np.array([best[p] for p in at], dtype=float)


def _plain(at: np.ndarray, n: int, step: int, every: int) -> np.ndarray:
    """Positions, ``every`` apart, in the gaps between natural boundaries that no piece can span."""
    edge = np.concatenate(([0], at, [n]))
    wide = np.flatnonzero(np.diff(edge) > step)
    return np.concatenate([np.zeros(0, np.int64), *(np.arange(edge[k] + every, edge[k + 1], every, dtype=np.int64) for k in wide)])


def _with(at: np.ndarray, cost: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not plain.size:
        return at, cost
    at, cost = np.concatenate((at, plain)), np.concatenate((cost, np.full(plain.size, PENALTY["none"])))
    order = np.argsort(at, kind="stable")
    return at[order], cost[order]


def _best(at: np.ndarray, cost: np.ndarray, n: int, limit: int, overlap: int, ideal: float) -> tuple[float, list[int]]:
    """Least cost and its cuts over the positions ``at``; infinite where these allow no segmentation."""
    at, cost = np.concatenate(([0], at, [n])), np.concatenate(([0.0], cost, [0.0]))
    step = limit - overlap
    best, back = np.full(len(at), np.inf), np.zeros(len(at), dtype=np.int64)
    best[0] = 0.0
    lows = np.searchsorted(at, at - step, side="left").tolist()
    first = int(np.searchsorted(at, max(overlap, 1), side="left"))  # a piece must reach beyond what it repeats of its predecessor
    spots, costs, unit = at.tolist(), cost.tolist(), 1.0 / ideal
    scaled = at * unit
    for j in range(1, len(spots)):
        top, arg = np.inf, 0
        if spots[j] <= limit:
            top = (spots[j] * unit - 1.0) ** 2
        i0 = max(lows[j], first)
        if i0 < j:
            total = scaled[i0:j] - (scaled[j] + overlap * unit - 1.0)
            total *= total
            total += best[i0:j]
            k = int(total.argmin())
            if total[k] < top:
                top, arg = float(total[k]), i0 + k
        best[j], back[j] = top + costs[j], arg
    out, j = [], len(spots) - 1
    while j:
        out.append(j - 1)
        j = int(back[j])
    return float(best[-1]), out[::-1]


def _reach(at: list[int], cost: list[float], first: int, step: int) -> list[float]:
    """Least sum of penalties before each position: a lower bound of any segmentation that cuts there."""
    out: list[float] = []
    window: deque[tuple[int, float]] = deque()
    for p, c in zip(at, cost, strict=True):
        while window and window[0][0] < p - step:
            window.popleft()
        low = 0.0 if p <= first else window[0][1] if window else math.inf
        out.append(low)
        low += c
        while window and window[-1][1] >= low:
            window.pop()
        window.append((p, low))
    return out


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces ``(start, end, kind of the cut at its end)`` of one text, of least cost.

    A first pass over the better boundaries gives a cost that can be reached. A position takes part in
    the second, exact pass unless the penalties that any segmentation through it must pay already
    exceed that cost, so no position of a best segmentation is left out.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, "end")] if n else []
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    step = limit - overlap
    natural, penalty = boundaries(text, step)
    count = max(2, -(-(n - overlap) // step))
    ideal = (n - overlap) / count + overlap
    better = natural[penalty < PENALTY["blank"]]
    edge = np.concatenate(([0], better, [n]))
    place = np.searchsorted(edge, natural, side="right")
    dense = (edge[np.minimum(place, edge.size - 1)] - edge[place - 1]) <= step // 4
    keep = (penalty < PENALTY["blank"]) | ~dense
    at, cost = _with(natural[keep], penalty[keep], _plain(natural, n, step, max(1, step // 8)))
    reached, chosen = _best(at, cost, n, limit, overlap, ideal)
    every, price = _with(natural, penalty, _plain(natural, n, step, 1))
    # any segmentation has at least so many cuts, and one through a blank that was left out pays for it too
    least = PENALTY["blank"] + (-(-(n - limit) // step) - 1) * float(penalty.min(initial=PENALTY["none"]))
    if every.size > at.size and reached > least - 1e-9:
        before = _reach(every.tolist(), price.tolist(), limit, step)
        # from the text's end: the last piece may be a whole step behind its cut
        after = _reach((n - every)[::-1].tolist(), price[::-1].tolist(), step, step)[::-1]
        open_ = np.array(before) + price + np.array(after) <= reached + 1e-9
        at, cost = every[open_], price[open_]
        reached, chosen = _best(at, cost, n, limit, overlap, ideal)
    names = {v: k for k, v in PENALTY.items()}
    out, start = [], 0
    for j in chosen:
        end = int(at[j]) if j < at.size else n
        kind = "end" if end == n else names[float(cost[j])]
        if kind == "none" and _stretch_at(text, end, limit) <= limit:
            kind = "overlap"  # the stretch itself would fit a piece, but not with what the piece repeats
        out.append((start, end, kind))
        start = end - overlap
    return out


def _stretch_at(text: str, at: int, limit: int) -> int:
    """Length of the stretch around a position, as far as beyond ``limit`` matters."""
    low = text[max(0, at - limit - 1) : at]
    left = len(low) - max((m.end() for m in _BREAK.finditer(low)), default=0)
    stop = _BREAK.search(text, at, at + limit + 1)
    return left + ((stop.start() if stop else min(len(text), at + limit + 1)) - at)


SCHEMA = "src string, row_id long, pos int, piece int, start_pos int, end_pos int, cut_at string, cut string, text string"


def _cut_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = SCHEMA.replace(",", "").split()[::2]
    for pdf in batches:
        rows = []
        for src, row_id, pos, text, limit, overlap in pdf.itertuples(index=False):
            pieces = cut(text, limit, overlap)
            whole = "hard" if any(kind == "none" for _, _, kind in pieces) else "soft"
            rows.extend((src, row_id, pos, k, a, b, kind, whole, text[a:b]) for k, (a, b, kind) in enumerate(pieces))
        yield pd.DataFrame(rows, columns=names)


def items(sections: DataFrame, ssc_input: DataFrame, body_limit: int = BODY_LIMIT, element_limit: int = ELEMENT_LIMIT, body_overlap: int = BODY_OVERLAP, element_overlap: int = ELEMENT_OVERLAP) -> DataFrame:
    """All items over their limit; the length test runs in the JVM, before any text reaches Python."""
    bodies = sections.where(F.char_length("body") > body_limit).select(
        F.lit("sections").alias("src"), F.col("section_id").alias("row_id"), F.lit(-1).alias("pos"),
        F.col("body").alias("text"), F.lit(body_limit).alias("limit"), F.lit(body_overlap).alias("overlap"))
    elements = (
        ssc_input.select("input_id", F.posexplode("sentences").alias("pos", "text"))
        .where(F.char_length("text") > element_limit)
        .select(F.lit("ssc_input").alias("src"), F.col("input_id").alias("row_id"), "pos", "text",
                F.lit(element_limit).alias("limit"), F.lit(element_overlap).alias("overlap")))
    return bodies.unionByName(elements)


def split_items(over: DataFrame) -> DataFrame:
    """Pieces of ``(src, row_id, pos, text, limit, overlap)`` items; see ``SCHEMA``."""
    return over.select("src", "row_id", "pos", "text", "limit", "overlap").mapInPandas(_cut_batches, SCHEMA)


def found(pieces: DataFrame) -> DataFrame:
    """One row per item that was cut, with the manner of its cutting."""
    return pieces.where("piece = 0").select("src", "row_id", "pos", "cut")
