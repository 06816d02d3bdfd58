"""Problem 5: noise in text from scanned pages.

1. One pass over each text finds page furniture, words cut at line ends, and the words of every line. A
   running header has the form of one (authors, venue, title), or is made of capitalised words and breaks
   into a sentence where the text wouldn't have been wrapped; what repeats such a line in the text, or in
   two other texts, is a header too.
2. The vocabulary is counted over all texts. Skip-gram vectors of its frequent words are learned
   from all lines, by alternating least squares on the counts of neighbours.
3. Rare words are linked to far more frequent words that plausible glyph edits turn them into; each
   occurrence weighs its candidates by the edits, by how much more frequent the word is and by how much
   better its vector fits the vectors of the neighbours than the read form; it is a misreading only
   where the evidence suffices.
4. A cut word is noise where the joined form is the attested one; a hyphen that belongs to the word
   isn't.
5. ``repaired`` removes furniture, mends words and reflows lines into paragraphs.

Vocabulary, candidates and occurrences are joined as tables; nothing of a size that grows with the
data is broadcast or collected. Every word with ``FREQUENT`` occurrences may be what was printed, and has
a vector if such a word stands near it, however many words there are; where a vector is missing the
context says nothing. Words of one or two characters aren't tried as misreadings, lines over
``LONGEST_HEADER`` characters not as headers.

Defined results: null and empty texts and elements give no rows; blank lines count as lines, null
elements as places; texts known to be digital have no noise; a scanned body that is broken into
single characters (``_shattered``) has no noise and no words; equation numbers are content; repeated
rows give their places again; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.session import Stored, materialise, spread

FREQUENT = 12
#: A longer line is no running header.
LONGEST_HEADER = 160
#: Sets ``Noise.least`` only, on which no result depends.
MOST_VECTORS = 2_000_000
#: Skip-gram: random words a pair of neighbours is set against, passes over the counts, and the share of a
#: word's weight that holds its vector at zero.
NEGATIVES, PASSES, RIDGE = 5, 6, 0.01
#: Most vectors that a pass broadcasts (5 MB); more are joined as a table, with the same result.
BROADCAST_VECTORS = 50_000
#: Evidence for a misreading, in bits: needed at all; how much more frequent its word is at least; for a
#: sign that no word has; and per unit of fit to the context.
NEEDED_BITS, LINK_BITS, ODD_BITS, FIT_BITS = 5.0, 3.0, 2.0, 6.0
#: Occurrences of which a vector has learned half of what it can.
LEARNED = 2000
#: Fit of a read form whose own vector isn't known.
PLAIN_FIT = 0.2
#: Misread form and what was printed (fixed values).
GLYPHS = (
    ("c", "e"), ("e", "c"), ("ri", "n"), ("n", "ri"), ("†", "t"), ("í", "i"), ("ì", "i"), ("0", "o"), ("@", "a"), ("cl", "d"), ("d", "cl"),
    ("1", "l"), ("1", "i"), ("l", "i"), ("i", "l"), ("5", "s"), ("$", "s"), ("b", "h"), ("h", "b"), ("rn", "m"), ("m", "rn"), ("9", "g"),
    ("6", "b"), ("8", "b"), ("3", "e"), ("vv", "w"), ("w", "vv"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("y", "v"), ("v", "y"), ("u", "n"), ("n", "u"),
    ("|", "l"), ("!", "l"), ("€", "e"), ("¢", "c"), ("ſ", "s"), ("f", "ſ"), ("o", "0"), ("tl", "h"), ("li", "h"), ("ii", "u"), ("nn", "m"), ("0", "ó"),
)

_NUMBER = r"(?:[-–—] ?\d{1,4} ?[-–—]|\[ ?\d{1,4} ?\]|(?:p\.|pp\.|[Pp]age|Seite|S\.) ?\d{1,4}(?: ?(?:of|/|von) ?\d{1,4})?)"
_ROMAN = r"(?:x{0,3}(?:ix|iv|v?i{1,3}|v)|x{1,3})"
_PAGE = re.compile(rf"(?:{_NUMBER}|\d{{1,4}}|{_ROMAN})")
_DOTTED = re.compile(r"\d{1,4}\.")
_CAP = r"[A-ZÀ-Þ][a-zß-ÿ†@0-9]+(?:-[A-ZÀ-Þ][a-zß-ÿ†@0-9]+)*"
_UP = r"[A-ZÀ-Þ]{3,}(?:-[A-ZÀ-Þ]{2,})*"
_AUTHOR = rf"(?:{_CAP} et al\.|{_UP} ET AL\.|{_CAP} and {_CAP}|{_UP} AND {_UP}|[A-Z]\. (?:{_CAP}|{_UP}))"
_VENUE = (
    r"(?:(?:Transactions|Trans\.|Journal|Proceedings|Proc\.|Annals|Letters|TRANSACTIONS|PROC\.|JOURNAL|PROCEEDINGS)(?: [\w.&-]+){1,7}(?:, (?:Vol|VOL)\. ?\d+(?:, (?:No|NO)\. ?\d+)?)?"
    r"|(?:Preprint|PREPRINT|Manuscript|MANUSCRIPT|Working paper|WORKING PAPER), [a-zA-Z ]{3,30}?)")
_TITLE = rf"(?:[A-Z]\w+[A-Z]\w+: (?:[A-Z][\w-]*)(?: [A-Z][\w-]*)+|[A-Z]{{4,}}: [A-Z-]{{3,}}(?: [A-Z-]+)+)"
_HEADER = re.compile(rf"(?:\d{{1,4}}\s+)?(?:{_AUTHOR}|{_VENUE}|{_TITLE})(?:\s+\d{{1,4}})?")
#: What is left of a header that was cut off; only between two lines of one sentence.
_CUT_OFF = re.compile(rf"(?:\d{{1,4}}\s+)?(?:(?:Preprint|Manuscript),? ?[a-z ]*|(?:Transactions|Proc\.|Journal)(?: [\w.,]+)*|{_CAP} (?:et|et al?|an|and)|[A-Z][a-z]+[A-Z][a-z]+:(?: [A-Z][\w-]*)*)")
_STATUS = r"(?:not for circulation|under review|draft|in press|submitted)"
_INSIDE = re.compile(
    r"(?:(?<=\s)|^)(?:\d{1,4} {1,3})?(?:(?:Transactions|Trans\.|Journal) on (?:[A-Z][\w-]*)(?: [A-Z][\w-]*)*, Vol\. ?\d+, No\. ?\d+"
    rf"|(?:Preprint|Manuscript|PREPRINT|MANUSCRIPT), (?:{_STATUS}|{_STATUS.upper()})"
    r"|[A-Z][a-z]+[A-Z][a-z]+: [A-Z][\w-]*(?: [A-Z][\w-]*)+"
    r"|Proc\. [A-Z]\w+ (?:Workshop|Conference|Symposium|Conf\.) on [\w-]+ [\w-]+)(?: {2,3}\d{1,4}| \d{1,4}$)?(?=\s|$)")
_INSIDE_AUTHOR = re.compile(rf"(?<=[a-z,;:¬‐\xad-] )(?:\d{{1,4}} +)?(?:{_CAP} et al\.|{_CAP} and {_CAP}|[A-Z]\. {_CAP})(?: {{2,3}}\d{{1,4}})?(?= [a-z])")
_NO_HEADER_AFTER = frozenset("of by and with for from to as in on than prof dr that von de et y".split())
_INSIDE_NUMBER = re.compile(r"(?:(?<=\s)|^)(?:[-–—] \d{1,4} [-–—]|\[ \d{1,4} \]|Page \d{1,4} of \d{1,4})(?=\s|$)|^p\. \d{1,4}(?= [A-Z]|$)|(?<=[.!?] )p\. \d{1,4}$")
_END_NUMBER = re.compile(rf"(?:(?<=[.!?])|(?<=[.!?][\"”)\]]))\s+(\d{{1,4}}\.?|{_ROMAN})$")
_START_NUMBER = re.compile(rf"^(?:\d{{1,4}}|(?:x{{0,3}}(?:ix|iv|vi{{1,3}}|i{{2,3}})))\s+(?=[A-Z\"“„«¿¡]\S*)")
_MARKS = "-‐¬­⸗"
# Words are tried from their start only, so an endless word costs no more than its length.
_CUT_END = re.compile(rf"(?<![\w'’†@])((?:[^\W\d_]|[†@])[\w'’†@]*)([{_MARKS}])$")
_CUT_START = re.compile(r"[^\W_][\w'’†@|$€]*")
_CUT_INSIDE = re.compile(rf"(?<![\w'’†@])((?:[^\W\d_]|[†@])[\w'’†@]*)([{_MARKS}])\s+([^\W\d_][\w'’†@|$€]*)")
_WORD = re.compile(r"[^\s]+")
_UNSPACED = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_ROW = re.compile(r"\t| \| | & |(?:[^\s,]+, ){2,}[^\s,]+$|(?:(?:[\d.]+%?|n/a|-)(?: ± [\d.]+)?(?: |$)){3,}|^\s*(?:\(\d{1,3}\)|\d{1,3}[.)]|[a-z]\)|[-–•*]|\[\d+\]) \S")
_SMALL_WORDS = frozenset("of on and the for in to a an et al vol no pp by with from und der die des de la le du des y e".split())
_ODD_SIGN = re.compile(r"[=<>∑∀±|&\t\\{}\"“”„«»]|https?:|@")
_NEXT_SENTENCE = re.compile(r"[a-zß-ÿ]{2}[.!?] [A-ZÀ-Þ]")
_STOP_INSIDE = re.compile(r"[^\W\d_]{2}[.!?](?:\s|$)|[。！？।؟]")
_STRIP = ".,;:!?()[]{}\"'“”‘’«»„…—–。，、！？"

Event = tuple[int, str, str, str, str]  # pos, kind, left, right, mark


_END = re.compile(r"[.!?。！？।:]['\"”’»)\]]*(?:\[[\d, –-]+\])*$")


def _ends(line: str) -> bool:
    if not line or line[-1] not in ".!?。！？।:'\"”’»)]":
        return False
    return line[-1] in ".!?。！？।:" or _END.search(line, max(0, len(line.rstrip("'\"”’»)]0123456789, –-[")) - 1)) is not None


def _cut_end(line: str) -> re.Match | None:
    return _CUT_END.search(line) if line[-1:] in _MARKS and line else None


def _tokens(text: str) -> list[str]:
    out = []
    for w in text.split():
        w = w.strip(_STRIP)
        if w:
            out.append(w.lower())
    return out


def _header_line(line: str, before: str, after: str) -> bool:
    if not _HEADER.fullmatch(line):
        inside = before and not _ends(before) and after[:1].islower() and not after.startswith("al")
        return bool(inside and len(line) < 0.6 * len(before) and _CUT_OFF.fullmatch(line))
    if re.fullmatch(rf"{_CAP} et al\.|{_CAP} and {_CAP}", line):
        last = re.findall(r"[\w†@]+$", before)
        if before and not _ends(before) and last and last[0].lower() in _NO_HEADER_AFTER and not after[:1].islower():
            return False  # the end of a sentence that names authors
    return True


def _title_like(line: str) -> bool:
    """Whether a line is made of capitalised words and numbers, with small words between them, and ends no sentence."""
    words = line.split()
    if not 2 <= len(words) <= 12 or line[-1] in "!?:;-" or _ROW.search(line) or _ODD_SIGN.search(line) or _NEXT_SENTENCE.search(line) or not (words[0][0].isupper() or words[0].isdigit()):
        return False
    small = sum(w.lower().strip(".,") in _SMALL_WORDS for w in words[1:])
    names = sum(w[0].isupper() and w[1:2].isalpha() for w in words)
    return names > 0 and all(w[0].isupper() or w.strip("().,–-").isdigit() or w.lower().strip(".,") in _SMALL_WORDS for w in words) and small <= len(words) // 2


def _breaks_in(line: str, before: str, after: str) -> bool:
    """Whether a line stands inside a sentence and ends where the text around it wouldn't have been wrapped."""
    first = after.split(" ", 1)[0]
    return bool(before and not _ends(before) and after[:1].islower() and len(before) >= 24 and len(line) + 1 + len(first) <= 0.8 * len(before))


def header_key(line: str) -> str:
    """What repeats of a running header: its words, numbers apart."""
    return " ".join(re.sub(r"\d+", "0", line.lower()).strip(" 0").split())


def _alone(lines: list, i: int) -> bool:
    """Whether a number with a period stands by itself rather than ending a sentence."""
    before = next((lines[k] for k in range(i - 1, -1, -1) if lines[k] and not _PAGE.fullmatch(lines[k])), "")
    after = next((lines[k] for k in range(i + 1, len(lines)) if lines[k] and not _PAGE.fullmatch(lines[k])), "")
    return not before or _ends(before) or after[:1].islower()


def _shattered(text: str) -> bool:
    """Whether a text is broken into single characters, as a stamp at a page's side: nine of ten pieces, and five or more.

    Characters of scripts without blanks are whole pieces, as are the lines of a list, however short.
    """
    pieces = text.split()
    return len(pieces) >= 5 and 10 * sum(len(p) == 1 and _UNSPACED.match(p) is None for p in pieces) >= 9 * len(pieces)


def scan_lines(text: str) -> tuple[list[Event], list[tuple[int, list[str]]]]:
    """Events and words of a body from a scan; words of cut pairs are joined in the line where they begin."""
    lines = [x.strip() for x in text.split("\n")]
    if _shattered(text):
        return [], []
    events: list[Event] = []
    furniture = set()
    for i, line in enumerate(lines):
        if not line:
            continue
        if _PAGE.fullmatch(line) or (_DOTTED.fullmatch(line) and _alone(lines, i)):
            furniture.add(i)
            events.append((i, "page_number", "", "", ""))
    prose = _STOP_INSIDE.search(text) is not None
    maybe: dict[int, str] = {}
    for i, line in enumerate(lines):
        if line and i not in furniture and len(line) <= LONGEST_HEADER:
            before = next((lines[k] for k in range(i - 1, -1, -1) if lines[k] and k not in furniture), "")
            after = next((lines[k] for k in range(i + 1, len(lines)) if lines[k] and k not in furniture), "")
            titled = prose and _title_like(line)
            if _header_line(line, before, after) or (titled and 0 < i < len(lines) - 1 and lines[i - 1] and lines[i + 1] and _breaks_in(line, before, after)):
                furniture.add(i)
                events.append((i, "running_header", header_key(line), "", ""))
            elif titled:
                maybe[i] = header_key(line)
    # the same line on another page of the text is furniture wherever it stands
    known = {a for _, kind, a, _, _ in events if kind == "running_header" and a}
    for i, key in maybe.items():
        if key in known:
            furniture.add(i)
        events.append((i, "running_header" if key in known else "maybe_header", key, "", ""))
    content = [i for i, x in enumerate(lines) if x and i not in furniture]
    words: list[tuple[int, list[str]]] = []
    drop_first = False
    for n, i in enumerate(content):
        line = lines[i]
        if drop_first:
            line = _CUT_START.sub("", line, count=1)
        drop_first = False
        end = _cut_end(lines[i])
        start = _CUT_START.match(lines[content[n + 1]]) if end and n + 1 < len(content) else None
        if start and not start.group().isdigit():
            left, mark, right = end[1], end[2], start.group()
            events.append((i, "cut", left, right, mark))
            tail = _cut_end(line)
            line = line[: tail.start()] if tail else line
            drop_first = True
        words.append((i, _tokens(line)))
    return events, words


def scan_elements(elements: list) -> tuple[list[Event], list[tuple[int, list[str]]]]:
    """Events and words of an array of sentences from a scan."""
    events: list[Event] = []
    words: list[tuple[int, list[str]]] = []
    clean: list[str | None] = []
    for i, raw in enumerate(elements):
        if raw is None:
            clean.append(None)
            continue
        text = raw.strip()
        if _PAGE.fullmatch(text) or (_DOTTED.fullmatch(text) and _alone([x.strip() if x else "" for x in elements], i)):
            events.append((i, "page_number", "", "", ""))
            clean.append("")
            continue
        if len(text) <= LONGEST_HEADER and _HEADER.fullmatch(text):
            events.append((i, "running_header", "", "", ""))
            clean.append("")
            continue
        kept = _INSIDE.sub(" ", text)

        def author(m: re.Match) -> str:
            last = m.string[: m.start()].split()
            return m.group() if last and last[-1].lower().strip(",;:") in _NO_HEADER_AFTER else " "

        kept = _INSIDE_AUTHOR.sub(author, kept)
        if kept != text:
            events.append((i, "running_header", "", "", ""))
        bare = _INSIDE_NUMBER.sub(" ", kept).strip()
        bare = _START_NUMBER.sub("", _END_NUMBER.sub("", bare))
        if bare != kept.strip():
            events.append((i, "page_number", "", "", ""))
        clean.append(" ".join(bare.split()))
    for i, text in enumerate(clean):
        if not text:
            continue
        rest = text
        for m in _CUT_INSIDE.finditer(text):
            events.append((i, "cut", m[1], m[3], m[2]))
            rest = rest.replace(m.group(), " ", 1)
        end = _cut_end(text)
        follow = next((x for x in clean[i + 1 :] if x), None) if end else None
        start = _CUT_START.match(follow) if follow else None
        if start and start.group()[0].islower():
            events.append((i, "cut", end[1], start.group(), end[2]))
            rest = rest[: rest.rfind(end[1])]
        words.append((i, _tokens(rest)))
    return events, words


# ---- Spark ------------------------------------------------------------------------------------

SCANNED = "src string, row_id long, scanned boolean, pos int, kind string, a string, b string, mark string, words array<string>"


def _scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["src", "row_id", "scanned", "pos", "kind", "a", "b", "mark", "words"]
    for pdf in batches:
        rows = []
        for src, row_id, scanned, body, elements in pdf.itertuples(index=False):
            if src == "sections":
                if scanned:
                    events, words = scan_lines(body)
                else:
                    events, words = [], [(i, _tokens(x)) for i, x in enumerate(body.split("\n"))]
            elif scanned:
                events, words = scan_elements(list(elements))
            else:
                events, words = [], [(i, _tokens(x)) for i, x in enumerate(elements) if x]
            rows.extend((src, row_id, scanned, p, k, a, b, m, None) for p, k, a, b, m in events)
            rows.extend((src, row_id, scanned, p, "words", None, None, None, w) for p, w in words if w)
        yield pd.DataFrame(rows, columns=names)


def texts(sections: DataFrame, ssc_input: DataFrame) -> DataFrame:
    """Both tables in one form; of unknown origin counts as scanned."""
    scanned = F.coalesce(F.col("pdf_kind"), F.lit("")) != "digital"
    bodies = sections.where("body IS NOT NULL AND body <> ''").select(
        F.lit("sections").alias("src"), F.col("section_id").alias("row_id"), scanned.alias("scanned"), "body", F.lit(None).cast("array<string>").alias("elements"))
    lists = ssc_input.where("size(sentences) > 0").select(
        F.lit("ssc_input").alias("src"), F.col("input_id").alias("row_id"), scanned.alias("scanned"), F.lit(None).cast("string").alias("body"), F.col("sentences").alias("elements"))
    return bodies.unionByName(lists)


def scan(rows: DataFrame) -> DataFrame:
    """Events and words of every text, stored once; see ``SCANNED``."""
    return materialise(spread(rows, "src", "row_id").mapInPandas(_scan_batches, SCANNED))


def vocabulary(scanned: DataFrame) -> DataFrame:
    """Counts ``(word, n)`` over all texts."""
    return materialise(scanned.where("kind = 'words'").select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")))


def furniture(scanned: DataFrame) -> DataFrame:
    """Page numbers and running headers; a title-like line is a header too where two other texts have it as theirs."""
    sure = scanned.where("kind IN ('running_header', 'page_number')").select("src", "row_id", "pos", "kind")
    keys = scanned.where("kind = 'running_header' AND a <> ''").select(F.col("a").alias("key"), "src", "row_id").distinct().groupBy("key").count().where("count >= 2").select("key")
    more = scanned.where("kind = 'maybe_header'").select("src", "row_id", "pos", F.col("a").alias("key")).join(keys, "key", "left_semi")
    return sure.unionByName(more.select("src", "row_id", "pos", F.lit("running_header").alias("kind")))


def neighbours(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """How often the words ``(word, id)`` stand next to each other or one word apart: ``(a, b, n)``, both ways."""
    near = F.explode(F.arrays_zip(F.col("words").alias("w"), F.expr("slice(words, 2, size(words))").alias("x"), F.expr("slice(words, 3, size(words))").alias("y"))).alias("z")
    pairs = scanned.where("kind = 'words' AND size(words) > 1").select(near).select(F.col("z.w").alias("v"), F.explode(F.array("z.x", "z.y")).alias("w")).where("w IS NOT NULL")
    pairs = pairs.groupBy(F.least("v", "w").alias("v"), F.greatest("v", "w").alias("w")).agg(F.count("*").alias("n"))
    for side, name in (("v", "a"), ("w", "b")):
        pairs = pairs.join(known.select(F.col("word").alias(side), F.col("id").alias(name)), side)
    return pairs.select(F.explode(F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n"))).alias("p")).select("p.*")


def vectors(scanned: DataFrame, words: DataFrame, size: int = 12, seed: int = 11) -> DataFrame:
    """Skip-gram vectors ``(word, vector)`` of all words with ``FREQUENT`` occurrences that stand near another one.

    Skip-gram with negative sampling, all negatives in expectation and the logistic loss replaced by its
    quadratic bound at 0: per pass, each word's vector is the exact minimum given those of its neighbours. Vocabulary,
    counts and vectors are tables; the driver holds the moments of the vectors (``size`` squared numbers).
    Vectors begin with the hash of their word and follow from the counts only, so neither the order of the rows, the
    partitions nor the size of the input matters: a corpus given twice has the vectors of the corpus (but those of
    words that only then are frequent).
    """
    xs = [f"x{i}" for i in range(size)]
    square = [(i, j) for i in range(size) for j in range(i, size)]
    known = Stored(words.where(F.col("n") >= FREQUENT).select("word", F.monotonically_increasing_id().alias("id")))
    # rows of a word lie together, so their sums need no more than a row each
    pairs = Stored(neighbours(scanned, known.df).repartition("a").sortWithinPartitions("a"))
    first = [(F.xxhash64("word", F.lit(seed * size + i)) / F.lit(2.0**64)).alias(x) for i, x in enumerate(xs)]
    now = Stored(pairs.df.groupBy(F.col("a").alias("id")).agg(F.sum("n").cast("double").alias("weight")).join(known.df, "id").select("id", "weight", *first))
    schema = "id long, weight double, " + ", ".join(f"{x} double" for x in xs)

    def sums(w: str) -> list[Column]:
        return [F.expr(x) for x in (f"sum({w}) AS weight", *(f"sum({w} * {x}) AS s_{x}" for x in xs), *(f"sum({w} * x{i} * x{j}) AS q{i}_{j}" for i, j in square))]

    def parted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight, weighted sum and weighted squares of vectors, one row each."""
        both = np.empty((len(rows), size, size))
        for k, (i, j) in enumerate(square):
            both[:, i, j] = both[:, j, i] = rows[:, 1 + size + k]
        return rows[:, 0], rows[:, 1 : 1 + size], both

    moments, pulls = sums("weight"), sums("n")
    few = now.df.limit(BROADCAST_VECTORS + 1).count() <= BROADCAST_VECTORS
    for _ in range(PASSES):
        row = now.df.agg(*moments).first()
        if row[0] is None:
            break
        total, mean, square_mean = (x[0] for x in parted(np.array([row], dtype=float)))
        mean, square_mean = mean / total, square_mean / total

        def solve(batches: Iterator[pd.DataFrame], mean: np.ndarray = mean, square_mean: np.ndarray = square_mean) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                n, near, both = parted(pdf.drop(columns="id").to_numpy(dtype=float))
                left = both + n[:, None, None] * (NEGATIVES * square_mean + RIDGE * np.eye(size))
                right = 2 * (near - NEGATIVES * n[:, None] * mean)
                out = pd.DataFrame(np.linalg.solve(left, right[..., None])[..., 0], columns=xs)
                out.insert(0, "id", pdf["id"].to_numpy())
                out.insert(1, "weight", n)
                yield out

        ends = now.df.select(F.col("id").alias("b"), *xs)
        near = pairs.df.join(F.broadcast(ends), "b") if few else pairs.df.join(ends.hint("merge"), "b").drop("b").repartition("a")
        new = Stored(near.groupBy(F.col("a").alias("id")).agg(*pulls).mapInPandas(solve, schema))
        now.drop()
        now = new
    # what all vectors share says nothing about a context
    mean = now.df.agg(*(F.avg(x) for x in xs)).first()
    made = materialise(now.df.join(known.df, "id").select("word", F.array(*(F.col(x) - F.lit(m) for x, m in zip(xs, mean, strict=True))).alias("vector")))
    for table in (now, pairs, known):
        table.drop()
    return made


def variants(word: str) -> list[tuple[str, int]]:
    """What may have been printed where ``word`` was read: one or two glyph edits."""

    def once(w: str) -> set[str]:
        out = set()
        for wrong, right in GLYPHS:
            at = w.find(wrong)
            while at >= 0:
                out.add(w[:at] + right + w[at + len(wrong) :])
                at = w.find(wrong, at + 1)
        return out

    first = once(word) - {word}
    every = {}
    for wrong, right in GLYPHS:
        if not wrong.isalpha() and word.count(wrong) > 1:
            first.add(word.replace(wrong, right))
    if not word.isalpha():  # a digit or sign inside may stand beside a second misreading
        for w in first:
            for v in once(w):
                every[v] = 2
    every.update(dict.fromkeys(first, 1))
    every.pop(word, None)
    return sorted(every.items())


def _variant_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(w, n, not w.isalpha(), v, e) for w, n in pdf.itertuples(index=False) for v, e in variants(w)]
        yield pd.DataFrame(rows, columns=["rare", "n_rare", "odd", "word", "edits"])


def candidates(words: DataFrame, frequent: DataFrame, longest: int) -> DataFrame:
    """Rare words and the frequent words they may be misreadings of: ``(rare, word, edits, prior)``.

    ``prior`` is the evidence without context, in bits: how much more frequent the word is, and signs that no
    word has.
    ``longest`` is the length of the longest frequent word; an edit shortens by two characters at most.
    """
    shape = F.regexp_count("word", F.lit(r"[\p{L}]")) * 2 > F.char_length("word")
    rare = words.where((F.char_length("word").between(3, longest + 4)) & shape).select("word", "n")
    tasks = 3 * words.sparkSession.sparkContext.defaultParallelism
    made = rare.repartition(tasks, "word").mapInPandas(_variant_batches, "rare string, n_rare long, odd boolean, word string, edits int")
    ratio = F.log2(F.col("n") / F.col("n_rare"))
    prior = ratio + F.when(F.col("odd"), ODD_BITS).otherwise(0.0) - (F.col("edits") - 1)
    return made.join(frequent, "word").where(ratio >= LINK_BITS).select("rare", "word", "n", "edits", prior.alias("prior"))


def _cut_words(scanned: DataFrame) -> DataFrame:
    joined = F.lower(F.concat("a", "b"))
    return scanned.where("kind = 'cut'").select(
        "src", "row_id", "pos", "mark", "a", "b", joined.alias("joined"), F.lower(F.concat("a", F.lit("-"), "b")).alias("whole"),
        F.lower("a").alias("la"), F.lower("b").alias("lb"))


def hyphens(scanned: DataFrame, words: DataFrame) -> DataFrame:
    """Cut words with ``noise`` true where the mark doesn't belong to the word."""
    cuts = _cut_words(scanned)
    for key in ("joined", "whole", "la", "lb"):
        cuts = cuts.join(words.select(F.col("word").alias(key), F.col("n").alias(f"n_{key}")), key, "left")
    n = {k: F.coalesce(F.col(f"n_{k}"), F.lit(0)) for k in ("joined", "whole", "la", "lb")}
    compound = (n["whole"] > n["joined"]) | ((n["joined"] == 0) & (n["lb"] >= FREQUENT) & (F.char_length("lb") > 1))
    return cuts.withColumn("noise", (F.col("mark") != "-") | ~compound)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def misreadings(scanned: DataFrame, words: DataFrame, vecs: DataFrame) -> DataFrame:
    """Occurrences ``(src, row_id, pos, at, nth, rare, word, bits)`` of misread words, decided in context.

    An occurrence is a misreading where the evidence for its best candidate, how much better the candidate
    fits the context than the read form included, reaches ``NEEDED_BITS``; any other stays as it was read.
    ``nth`` counts the same form before it in the line.
    """
    frequent = words.where(F.col("n") >= FREQUENT).select("word", "n")
    cuts = _cut_words(scanned).select("src", "row_id", "pos", "joined")
    unknown = cuts.select(F.col("joined").alias("word")).distinct().join(words, "word", "left_anti").select("word", F.lit(1).cast("long").alias("n"))
    longest = frequent.agg(F.max(F.char_length("word"))).first()[0] or 0
    linked = materialise(candidates(words.unionByName(unknown), frequent, longest))
    lines = scanned.where("kind = 'words' AND scanned").select("src", "row_id", "pos", "words")
    # narrow rows meet the linked words first; only lines with a hit are joined for their neighbours
    hits = lines.select("src", "row_id", "pos", F.posexplode("words").alias("at", "rare")).join(linked.select("rare").distinct(), "rare", "left_semi")
    near = F.filter(F.slice("words", F.greatest(F.lit(1), F.col("at") - 1), F.when(F.col("at") > 1, 5).otherwise(F.col("at") + 3).cast("int")), lambda w: w != F.col("rare"))
    nth = F.size(F.filter(F.expr("slice(words, 1, at)"), lambda w: w == F.col("rare")))
    spots = materialise(hits).join(lines, ["src", "row_id", "pos"]).withColumn("near", near).withColumn("nth", nth).drop("words")
    own = cuts.withColumn("at", (-1 - F.pmod(F.xxhash64("joined"), F.lit(1 << 30))).cast("int")).select("src", "row_id", "pos", "at", F.col("joined").alias("rare"))
    # a cut word's line holds the words before it, which are its context
    own = own.join(linked.select("rare").distinct(), "rare", "left_semi").join(lines, ["src", "row_id", "pos"], "left")
    own = own.withColumn("near", F.coalesce(F.expr("slice(words, -2, 2)"), F.array())).withColumn("nth", F.lit(0)).drop("words")
    spots = materialise(spots.unionByName(own))
    context = (spots.select("src", "row_id", "pos", "at", F.explode("near").alias("word")).join(vecs, "word")
               .select("src", "row_id", "pos", "at", F.posexplode("vector").alias("d", "x"))
               .groupBy("src", "row_id", "pos", "at", "d").agg(F.avg("x").alias("x"))
               .groupBy("src", "row_id", "pos", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("around")))
    read = vecs.select(F.col("word").alias("rare"), F.col("vector").alias("read"))
    choice = spots.drop("near").join(linked, "rare").join(vecs, "word", "left").join(read, "rare", "left").join(context, ["src", "row_id", "pos", "at"], "left")
    choice = choice.withColumn("fit", _cosine("vector", "around")).withColumn("read_fit", F.coalesce(_cosine("read", "around"), F.lit(PLAIN_FIT)))
    # a word or a context without vectors says nothing for or against, a vector of few occurrences little
    trust = F.col("n") / (F.col("n") + LEARNED)
    choice = choice.withColumn("bits", F.round(F.col("prior") + F.coalesce(FIT_BITS * trust * (F.col("fit") - F.col("read_fit")), F.lit(0.0)), 6))
    best = Window.partitionBy("src", "row_id", "pos", "at").orderBy(F.col("bits").desc(), F.col("n").desc(), F.col("word"))
    return choice.withColumn("_k", F.row_number().over(best)).where(F.col("_k") == 1).where(F.col("bits") >= NEEDED_BITS).select("src", "row_id", "pos", "at", "nth", "rare", "word", "bits")


def _cosine(a: str, b: str) -> Column:
    x, y = F.col(a), F.col(b)
    return F.round(F.try_divide(_dot(x, y), F.sqrt(_dot(x, x) * _dot(y, y))), 6)


class Noise:
    """All noise of a corpus: furniture, cut words and misreadings."""

    def __init__(self, sections: DataFrame, ssc_input: DataFrame):
        self.texts = texts(sections, ssc_input)
        self.scanned = scan(self.texts)
        self.furniture = furniture(self.scanned)
        self.words = vocabulary(self.scanned)
        total = self.words.agg(F.sum("n")).first()[0] or 0
        self.least = max(FREQUENT, total // MOST_VECTORS)
        self.hyphens = hyphens(self.scanned, self.words).where("noise")
        spark = sections.sparkSession
        most = self.words.agg(F.max("n")).first()[0] or 0
        if most < FREQUENT:
            self.misread = spark.createDataFrame([], "src string, row_id long, pos int, at int, nth int, rare string, word string, bits double")
        else:
            self.misread = misreadings(self.scanned, self.words, vectors(self.scanned, self.words))

    def found(self) -> DataFrame:
        """One row ``(src, row_id, pos, noise)`` per damaged place."""
        furniture = self.furniture.select("src", "row_id", "pos", F.col("kind").alias("noise"))
        cut = self.hyphens.select("src", "row_id", "pos", F.lit("hyphen").alias("noise"))
        char = self.misread.select("src", "row_id", "pos", F.lit("char").alias("noise"))
        return furniture.unionByName(cut).unionByName(char).distinct()

    def repaired(self) -> DataFrame:
        """``(src, row_id, text)``: paragraphs of the text itself; sections from scans and arrays."""
        fixes = self.furniture.select("src", "row_id", "pos", "kind", F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0).alias("nth"))
        fixes = fixes.unionByName(self.hyphens.select("src", "row_id", "pos", F.lit("cut").alias("kind"), "a", "b", F.lit(0).alias("nth")))
        fixes = fixes.unionByName(self.misread.select("src", "row_id", "pos", F.lit("char").alias("kind"), F.col("rare").alias("a"), F.col("word").alias("b"), F.when(F.col("at") < 0, -1).otherwise(F.col("nth")).alias("nth")))
        per_row = fixes.groupBy("src", "row_id").agg(F.collect_list(F.struct("pos", "kind", "a", "b", "nth")).alias("fixes"))
        return self.texts.where("scanned").join(per_row, ["src", "row_id"], "left").select("src", "row_id", "body", "elements", "fixes").mapInPandas(_mend_batches, "src string, row_id long, text string")


def _recase(old: str, new: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new


def _correct(text: str, a: str, b: str, nth: int) -> str:
    """The text with the occurrence ``nth`` of the whole word ``a`` corrected to ``b``."""
    for k, m in enumerate(re.finditer(rf"(?<!\w){re.escape(a)}(?!\w)", text, re.I)):
        if k == nth:
            return text[: m.start()] + _recase(m.group(), b) + text[m.end() :]
    return text


def mend(lines: list[str | None], fixes: list[tuple], by_line: bool = False) -> str:
    """Reflowed text of lines or elements, given their fixes ``(pos, kind, a, b, nth)``.

    A misread word is corrected in its own line and place; ``nth`` is -1 for a word cut at the line's end.
    Furniture takes up its line if ``by_line``, else it may stand inside an element.
    """
    gone = {p for p, k, *_ in fixes if k in ("running_header", "page_number")}
    joins: dict[int, list[tuple[str, str]]] = {}
    chars: dict[int, list[tuple[int, str, str]]] = {}
    for p, k, a, b, nth in fixes:
        if k == "cut":
            joins.setdefault(p, []).append((a, b))
        elif k == "char":
            chars.setdefault(p, []).append((nth, a, b))
    paragraphs: list[str] = []
    current, glue = "", False
    cut: list[tuple[str, str]] = []  # corrections of the word that the next line completes
    for i, raw in enumerate(lines):
        if raw is None:
            continue
        line = raw.strip()
        if i in gone:
            line = "" if by_line or _PAGE.fullmatch(line) or _HEADER.fullmatch(line) else _START_NUMBER.sub("", _END_NUMBER.sub("", _INSIDE_NUMBER.sub(" ", _INSIDE.sub(" ", line))))
            if not line:
                continue
        elif not line:
            if current and _ends(current):
                paragraphs.append(current)
                current = ""
            continue
        # from the last occurrence on, so that those before keep their count
        for nth, a, b in sorted((x for x in chars.get(i, ()) if x[0] >= 0), reverse=True):
            line = _correct(line, a, b, nth)
        split = [(a, b) for nth, a, b in chars.get(i, ()) if nth < 0]
        for a, b in joins.get(i, ()):
            line = re.sub(rf"{re.escape(a)}[{_MARKS}]\s+{re.escape(b)}", a + b, line)
        waiting = []
        for a, b in split:
            mended = line if by_line else _correct(line, a, b, 0)
            if mended == line:
                waiting.append((a, b))
            line = mended
        if current and not glue and _ROW.search(line):
            paragraphs.append(current)
            current = ""
        if glue:
            word = len(current) - len(re.search(r"\S*$", current).group())
            joined = current[word:] + line
            for a, b in cut:
                joined = _correct(joined, a, b, 0)
            current = current[:word] + joined
        else:
            current = f"{current} {line}" if current else line
        glue, cut = False, []
        if any(re.search(rf"{re.escape(a)}[{_MARKS}]$", current) for a, _ in joins.get(i, ())):
            current, glue, cut = current[:-1], True, waiting
        elif re.search(r"\w-$", current):
            glue = True
    if current:
        paragraphs.append(current)
    return "\n".join(" ".join(p.split()) for p in paragraphs)


def _mend_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for src, row_id, body, elements, fixes in pdf.itertuples(index=False):
            lines = body.split("\n") if src == "sections" else list(elements)
            marks = [(f["pos"], f["kind"], f["a"], f["b"], f["nth"]) for f in (fixes if fixes is not None else ())]
            rows.append((src, row_id, mend(lines, marks, src == "sections")))
        yield pd.DataFrame(rows, columns=["src", "row_id", "text"])
