"""Problem 1: sentence units in any language and script.

A line is cut by semi-Markov dynamic programming over its candidate boundaries: whole spans are
scored jointly by their length, the word they open with, the word they close with and the balance of
their quotations, and the best segmentation of the line wins. Opening words are learned from the line
starts of the corpus. Places where nothing could open a sentence are no candidates, and lines that are
one unit by definition (entries, captions, table rows) are told by their form.

Defined results: null, empty and blank texts give no units; a line break always ends a unit; a line
that is a bibliographic entry, a caption or a table row is one unit, and so is such a line of an
array's element; a list marker belongs to its item; no unit ends inside a closed quotation; null
elements of an array are left out and the others joined by one blank; very long lines
cost time in proportion to their length; repeated rows give their units again; extra columns aren't
read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.session import materialise, spread

# Abbreviations after which a sentence doesn't end (lower case, without the last period).
INNER = frozenset(
    "dr mr mrs prof st sr dra sra hr fr mme mlle messrs rev gen col capt lt sgt"
    " fig figs eq eqs sec secs sect sects ch chap app tab tabs no nos pp vs ca cf approx max resp"
    " viz e.g i.e cond proc conf ref refs alg thm def ex ej abb vgl bzw nr kap abschn evtl ggf sog"
    " z.b d.h u.a p.ex p.ej π.χ δηλ βλ εικ σελ डॉ श्री د ดร ee núm pág cap".split()
)
# Abbreviations that may also end a sentence.
EITHER = frozenset(
    "etc al u.s u.k u.s.a e.u uu p.m a.m inc ltd corp co ed eds vol jr phd ph.d usw dept univ est min int κ.λπ κλπ".split()
)
# After these a number belongs to the abbreviation.
NUMBERED = frozenset("min vol no nos pp p ch sec fig tab eq app".split())
# Words before a German ordinal number.
ORDINAL_LEFT = frozenset("am im vom zum der den dem ab bis das die beim seit".split())
# Function words that open sentences; ``openers`` learns the others from the corpus.
OPENERS = frozenset(
    "the a an in on at we our this that these those it its as for to with by from since across however moreover therefore although"
    " under during despite each one few le la les un une nous cette ces der die das ein eine wir wie im el los las en una".split()
)
#: A learned opener has at least this share of all line starts, so there are at most 20,000; it starts lines
#: at least so many times as often as it stands capitalised inside a line.
LEAST_SHARE, STARTS_OVER_INNER = 1 / 20_000, 2.0
#: Longer words are no abbreviations; only so many characters before a stop are looked at.
LONGEST_WORD = 64
CLOSERS = "\"'”’“»›)]）」』】〉》"
OPENING_QUOTES, CLOSING_QUOTES = "“„«「『‹", "”»」』›"
LONGEST_STEP = 48

_MARKER = re.compile(r"\s*(?:\(\d{1,3}\)|\d{1,3}[.)]|\([a-zA-Z]\)|[a-zA-Z]\)|[-–—•*·‣▪])\s+(?=\S)")
_BIB = re.compile(r"\s*\[\d{1,4}\]\s+\S.*\b(?:1[89]|20)\d\d\b.{0,4}$")
_CAPTION = re.compile(r"\s*(?:Table|Tab\.|Figure|Fig\.|Tabelle|Abb\.|Abbildung|Tableau|Tabla|Figura|表|图|図)\s*\d+\s*[:.：]")
_VALUE = re.compile(r"(?:[-–—]|n/a|[<>=±~≈]?\s?[-−+]?\d[\d.,]*\s?%?(?: ?± ?[\d.]+)?)\s*(?:\\\\)?")
_ENDS_INSIDE = re.compile(r"(?:[^\W\d_]{2}|[)\]\"”])[.!?]\s+\S|[。！？।؟]\s*\S")
_QUOTE = re.compile(r"[\"“”„«»‹›「」『』]")
_CLOSES = {'"': '"', "“": "„", "”": "“„", "«": "»", "»": "«", "‹": "›", "›": "‹", "」": "「", "』": "『"}
_STOP = re.compile(r"[.!?…‥⋯]+|[。！？｡]+|[।॥]+|[؟]+|[;;](?=\s|$)|(?<=[฀-๿])[  ]+(?=[฀-๿])")
_MARKS = re.compile(r"(?:\[\d+(?:\s*[,–-]\s*\d+)*\])+|[⁰¹²³⁴-⁹]+")
_BEFORE_WORD = frozenset(" \t\u00a0\u3000\"“”„«»‘’([（「『")
_ODD_START = re.compile(r"[a-z](?:[A-Z]|-[a-z])")
_GLUED = re.compile(r".*(?:[^\W\d_]{2}\.|[\d%)\]][.!?]|[!?\])\"”»])(?=[^\W\d_]+$)")
_WORD = re.compile(r"[^\W\d_]+")


def _tail(line: str, end: int) -> int:
    """Where the word that ends at ``end`` begins, ``LONGEST_WORD`` characters before at most."""
    floor = max(0, end - LONGEST_WORD)
    while end > floor and line[end - 1] not in _BEFORE_WORD:
        end -= 1
    return end


class _Stretch:
    """The run without blanks around a place, kept while the places move on inside it."""

    def __init__(self) -> None:
        self.end, self.address = -1, False

    def is_address(self, line: str, at: int) -> bool:
        """Whether the run around ``at`` is a web or mail address or a path."""
        if at >= self.end:
            start = max(line.rfind(" ", 0, at), line.rfind("\t", 0, at)) + 1
            self.end = line.find(" ", at)
            if self.end < 0:
                self.end = len(line)
            run = line[start : self.end]
            self.address = "/" in run or "@" in run.split(".", 1)[0]
        return self.address


def _last_piece(word: str) -> str:
    """The word itself where a sentence before it ended without a blank, as in ``done.Dr``."""
    m = None if word.lower() in INNER or word.lower() in EITHER else _GLUED.match(word)
    return word[m.end() :] if m else word


def _is_greek(c: str) -> bool:
    return "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿"


def _starts(line: str, at: int) -> str:
    """What could open a unit at ``at``: upper, lower, digit, quote, mark, paren, caseless or none."""
    c = line[at]
    if c.isupper():
        return "upper"
    if c.islower():
        return "odd" if _ODD_START.match(line, at) else "lower"
    if c.isdigit():
        return "digit"
    if c in "\"“„«‹「『'‘":
        return "quote"
    if c in "¿¡":
        return "mark"
    if c in "([（":
        inner = line[at + 1 : at + 2]
        return "paren" if c != "[" and inner.isupper() and not line.startswith(("cf", "see"), at + 1) else "none"
    return "caseless" if c.isalpha() else "none"


def _closing(line: str, stop: re.Match, end: int, after: int, spaced: bool, openers: frozenset[str], run: _Stretch) -> float:
    """Score of ending a unit at ``end`` and opening the next at ``after``."""
    term, at = stop.group(), stop.start()
    first = term[0]
    if first in "  ":
        return 3.0  # a blank between Thai phrases
    kind = _starts(line, after)
    word = _WORD.match(line, after)
    opener = 0.5 if word and word.group().lower() in openers else 0.0
    if first in "。！？｡।॥؟":
        if end > stop.end() and line[after] in "とって，、,的地」』":
            return -5.0  # a quotation carried on by the sentence around it
        return 3.0
    if kind == "none":
        return -4.0
    if first in ";;":
        return 3.0 if at and _is_greek(line[at - 1]) and kind in ("upper", "quote", "digit") else -6.0
    quoted = end > stop.end() and line[end - 1] in "\"”“»›」』"
    if kind == "lower":
        return -5.0
    if not spaced and kind not in ("upper", "odd", "quote", "paren", "mark", "digit"):
        return -4.0 if kind != "caseless" or first == "." else 2.0
    if first != "." or len(term) > 1:
        return 3.0 + opener
    if quoted:
        return 2.5 + opener
    begin = _tail(line, at)
    closer = _last_piece(line[begin:at])
    low = closer.lower().lstrip("'([").rstrip(")]")
    if not low:
        return 2.0 + opener if spaced or kind != "digit" else -5.0
    if not spaced:
        if run.is_address(line, after):
            return -5.0
        if kind == "upper" and not (line[after + 1 : after + 2].islower() or line[after + 1 : after + 2] in (" ", "")):
            if not line[after + 1 : after + 2].isdigit():
                return -4.0
        if kind == "digit" and not re.match(r"\d{1,3} [a-z]", line[after : after + 6]):
            return -5.0
        if len(low) == 1 and low.isalpha():
            return -5.0
        if kind == "digit" and not low[-2:].isalpha():
            return -5.0
    if low == "no" and kind != "digit":
        return 2.0 + opener
    if low in INNER or closer == "Ms":
        return -4.0
    if low in EITHER:
        if kind == "digit" and low in NUMBERED:
            return -4.0
        return 2.0 + opener
    if len(low) == 1 and low.isalpha():
        # an initial, or a letter of a spaced abbreviation
        return 0.4 if opener and closer.isupper() and spaced else -4.0
    if low in NUMBERED and kind == "digit":
        return -4.0
    if low.isdigit() and len(low) <= 2 and kind == "upper":
        gap = begin
        while gap and line[gap - 1].isspace():
            gap -= 1
        if gap and _last_piece(line[_tail(line, gap) : gap]).lower() in ORDINAL_LEFT:
            return -4.0
    return 3.0 + opener


def _length(n: int) -> float:
    """Mild preference for spans of the length sentences have."""
    return -0.25 * abs(math.log((n + 8) / 90.0))


def _quotes(line: str, cuts: list[int]) -> list[tuple[int, int]]:
    """State of open quotations at each cut: parity of the straight ones, depth of the others."""
    out, parity, depth, low, at = [], 0, 0, 0, 0
    for cut in cuts:
        for c in line[at:cut]:
            if c == '"':
                parity ^= 1
            elif c == "“" and low:
                low -= 1
                depth -= 1
            elif c in OPENING_QUOTES:
                depth += 1
                low += c == "„"
            elif c in CLOSING_QUOTES:
                depth -= 1
        at = cut
        out.append((parity, depth))
    return out


def _closed_quotations(line: str) -> list[tuple[int, int]]:
    """Outermost ``(start, end)`` of the quotations that are opened and closed within the line.

    Straight and angle quotes open and close by the side they stand on; one that stays open pairs with nothing.
    """
    out, stack, held = [], [], Counter()
    for m in _QUOTE.finditer(line):
        c, i = m.group(), m.start()
        before, after = line[i - 1 : i], line[i + 1 : i + 2]
        sided = c in '"«»‹›'
        opens = not before or not (before.isalnum() or before in ".,;!?…%)]")
        closes = not sided or (not after.isalnum() and not (c in '"«‹' and before.isspace()))
        at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in _CLOSES.get(c, "")), -1) if any(held.get(x) for x in _CLOSES.get(c, "")) else -1
        if at >= 0 and closes:
            begin = stack[at][1]
            held.subtract(x for x, _ in stack[at:])
            del stack[at:]
            while out and out[-1][0] > begin:
                out.pop()
            out.append((begin, i + 1))
        elif c in "“„「『" or (sided and opens and (c in "«‹" or not after.isspace())):
            if c == '"' and at >= 0:
                held.subtract(x for x, _ in stack[at:])
                del stack[at:]  # the one before it was never closed
            stack.append((c, i))
            held[c] += 1
    return out


def _row(line: str) -> bool:
    """Whether a line is a table row: several cells, most of them short or values."""
    for mark in ("\t", " | ", " & "):
        cells = [c.strip() for c in line.strip().split(mark)]
        if len(cells) < 2:
            continue
        short = sum(len(c.split()) <= 8 and _ENDS_INSIDE.search(c) is None for c in cells)
        value = any(_VALUE.fullmatch(c) for c in cells[1:])
        if mark != " & ":  # an ampersand also joins names
            row = value or short == len(cells) or (len(cells) > 2 and 2 * short > len(cells))
        else:
            row = (short == len(cells) and (value or len(cells) > 2)) or (len(cells) > 2 and value and 2 * short > len(cells))
        if row:
            return True
    return False


def _whole(line: str) -> bool:
    """Whether a line is one unit whatever it holds: a bibliographic entry, a caption or a table row."""
    return _BIB.match(line) is not None or _CAPTION.match(line) is not None or _row(line)


def _candidates(line: str, begin: int, openers: frozenset[str] = OPENERS) -> list[tuple[int, int, float]]:
    """``(end, next start, score)`` of every place where a unit could end inside the line."""
    out, n = [], len(line)
    seen, odd = 0, 0  # parity of straight quotes up to ``seen``
    closed, q, run = _closed_quotations(line), 0, _Stretch()
    # Leaving out a cut joins two spans: that never adds an unbalanced quotation, and its length costs at
    # most that of the whole line. A place that scores less is in no best segmentation.
    worst = min(0.0, _length(n))
    for stop in _STOP.finditer(line, begin):
        end = stop.end()
        thai = stop.group()[0] in "  "
        if thai:
            end = stop.start()
        else:
            odd ^= line.count('"', seen, end) & 1
            seen = end
            inside = odd
            while end < n and line[end] in CLOSERS:
                if line[end] == '"':
                    if not inside:
                        break  # it opens the next unit
                    inside = 0
                end += 1
            odd ^= line.count('"', seen, end) & 1
            seen = end
            marks = _MARKS.match(line, end)
            if marks:
                end = marks.end()
            # French and others put a blank before the closing quote
            if end + 1 < n and line[end] in "  " and line[end + 1] in "»”›" :
                end += 2
        while q < len(closed) and closed[q][1] <= end:
            q += 1
        if q < len(closed) and closed[q][0] < end:
            continue  # a quotation never ends the sentence around it, however much it holds
        after = end
        while after < n and line[after].isspace():
            after += 1
        if after >= n:
            break
        score = _closing(line, stop, end, after, after > end, openers, run)
        if score > worst:
            out.append((end, after, score))
    return out


def _back_many(starts: list[int], ends: list[int], scores: list[float], state: list[tuple[int, int]], step: int) -> list[int]:
    """The best predecessor of each end, as in ``cut_line``, with a window's spans scored at once."""
    n = len(ends)
    first, codes = np.array(starts, dtype=float) - 8.0, {}
    kind = np.array([codes.setdefault(s, len(codes)) for s in state])
    best, back = np.full(n + 1, -np.inf), [0] * (n + 1)
    best[0] = 0.0
    for j in range(1, n + 1):
        low = max(0, j - step)
        v = best[low:j] - 0.25 * np.abs(np.log((ends[j - 1] - first[low:j]) / 90.0)) - 6.0 * (kind[low:j] != kind[j])
        k = int(v.argmax())
        best[j], back[j] = v[k] + scores[j - 1], low + k
    return back


def cut_line(line: str, rows: bool = True, openers: frozenset[str] = OPENERS) -> list[tuple[int, int]]:
    """Units ``(start, end)`` of one line by dynamic programming over whole spans; entries, captions and rows stay whole if ``rows``."""
    lead = len(line) - len(line.lstrip())
    stop = len(line.rstrip())
    if stop <= lead:
        return []
    marker = _MARKER.match(line)
    begin = marker.end() if marker else lead
    if rows and _whole(line):
        return [(lead, stop)]
    places = _candidates(line, begin, openers)
    if not places:
        return [(lead, stop)]
    starts = [lead, *[a for _, a, _ in places]]
    ends = [*[e for e, _, _ in places], stop]
    scores = [*[s for _, _, s in places], 0.0]
    state = [(0, 0), *_quotes(line, ends)]
    n, step = len(ends), LONGEST_STEP
    while True:
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        if n > 4 * LONGEST_STEP:
            back = _back_many(starts, ends, scores, state, step)
        for j in range(1, n + 1) if n <= 4 * LONGEST_STEP else ():
            top, arg, sj, end = -math.inf, 0, state[j], ends[j - 1]
            for i in range(max(0, j - step), j):
                v = best[i] + _length(end - starts[i])
                if state[i] != sj:
                    v -= 6.0
                if v > top:
                    top, arg = v, i
            best[j], back[j] = top + scores[j - 1], arg
        spans, j, reach = [], n, 0
        while j:
            i = back[j]
            spans.append((starts[i], ends[j - 1]))
            reach = max(reach, j - i)
            j = i
        if reach < step or step >= n:
            break
        step *= 2  # a span met the window: look further, so the window never decides
    spans.reverse()
    return spans


def units(text: str, rows: bool = True, openers: frozenset[str] = OPENERS) -> list[tuple[int, int]]:
    """Units ``(start, end)`` of a text in reading order."""
    out, at = [], 0
    for line in text.split("\n"):
        out.extend((at + a, at + b) for a, b in cut_line(line, rows, openers))
        at += len(line) + 1
    return out


def joined_units(text: str, sizes: Iterable[int], openers: frozenset[str] = OPENERS) -> list[tuple[int, int]]:
    """Units of elements of the given sizes joined by one blank; lines that are one unit are told by element."""
    out, at, run = [], 0, 0
    for size in sizes:
        for line in text[at : at + size].split("\n"):
            if _whole(line):
                out.extend((run + a, run + b) for a, b in units(text[run:at], False, openers))
                out.append((at + len(line) - len(line.lstrip()), at + len(line.rstrip())))
                run = at + len(line)
            at += len(line) + 1
    out.extend((run + a, run + b) for a, b in units(text[run:], False, openers))
    return out


def texts(sections: DataFrame, ssc_input: DataFrame) -> DataFrame:
    """``(src, row_id, pdf_kind, text, sizes)`` of both tables, sizes of the joined elements; nothing else is read."""
    bodies = sections.select(F.lit("sections").alias("src"), F.col("section_id").alias("row_id"), "pdf_kind", F.col("body").alias("text"), F.lit(None).cast("array<int>").alias("sizes"))
    elements = F.filter("sentences", lambda s: s.isNotNull())
    joined, sizes = F.array_join(elements, " "), F.transform(elements, F.char_length)
    lists = ssc_input.select(F.lit("ssc_input").alias("src"), F.col("input_id").alias("row_id"), "pdf_kind", joined.alias("text"), sizes.alias("sizes"))
    return bodies.unionByName(lists).where(r"text IS NOT NULL AND text RLIKE '\\S'")


SCHEMA = "src string, row_id long, unit int, start_pos int, end_pos int, text string"


def openers(rows: DataFrame) -> frozenset[str]:
    """Words that open sentences, learned from the line starts of all texts, with the function words.

    A line start is a sentence start whatever stands before it. The driver gets at most
    1 / ``LEAST_SHARE`` words.
    """
    word = r"(\p{Lu}\p{Ll}*)(?![\p{L}.])"
    starts = F.transform(F.regexp_extract_all("text", F.lit(rf"(?m)^\s*{word}"), F.lit(1)), lambda w: F.struct(w.alias("w"), F.lit(1).alias("s")))
    inner = F.transform(F.regexp_extract_all("text", F.lit(rf"(?<=[\p{{Ll}},;] ){word}"), F.lit(1)), lambda w: F.struct(w.alias("w"), F.lit(0).alias("s")))
    counts = rows.select(F.explode(F.concat(starts, inner)).alias("x")).groupBy(F.lower("x.w").alias("word")).agg(
        F.sum("x.s").alias("starts"), F.sum(1 - F.col("x.s")).alias("inner"))
    counts = materialise(counts)
    total = counts.agg(F.sum("starts")).first()[0] or 0
    least = max(3.0, total * LEAST_SHARE)
    kept = counts.where((F.col("starts") >= least) & (F.col("starts") >= STARTS_OVER_INNER * F.col("inner"))).select("word").collect()
    return OPENERS | {r["word"] for r in kept}


def sentence_units(rows: DataFrame, opening: frozenset[str] = OPENERS) -> DataFrame:
    """Units of ``(src, row_id, text, sizes)`` rows; see ``SCHEMA``. ``opening`` are words that open sentences."""
    names = SCHEMA.replace(",", "").split()[::2]

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for src, row_id, text, sizes in pdf.itertuples(index=False):
                spans = units(text, True, opening) if sizes is None else joined_units(text, sizes.tolist(), opening)
                out.extend((src, row_id, k, a, b, text[a:b]) for k, (a, b) in enumerate(spans))
            yield pd.DataFrame(out, columns=names)

    return spread(rows.select("src", "row_id", "text", "sizes"), "src", "row_id").mapInPandas(batches, SCHEMA)


def found(unit_rows: DataFrame) -> DataFrame:
    return unit_rows.select("src", "row_id", "start_pos")
