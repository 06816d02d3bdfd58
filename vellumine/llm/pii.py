"""Problem 9: personal details in free text, by a semi-Markov conditional random field.

Candidate segments of five types come from lexical shapes, with several ends for one start where a
detail may be longer or shorter (a further name, an address with or without flat, town and code). Each
is scored as a whole by features of the span and of its two sides (form, label words, digit counts,
name lexicon), and dynamic programming picks boundaries and types jointly: the best set of segments of
bounded length that don't overlap. The weights maximise the conditional likelihood of labelled
sentences, with the expected features taken by the forward-backward recursion over all such sets and a
Gaussian prior around ``PRIORS``; the sentences are made by ``training_rows``.

Family and further given names are learned from the whole corpus: a word that follows two or more
listed given names, and them in a fifth of its distinct pairs or more, is a family name; a word that
precedes three or more family names, and them in a twentieth of its distinct pairs or more, is a given
name. Shares keep this the same at any size, and a pair counts once however often it is repeated. A
listed given name before a family name that wasn't learned counts inside a sentence. Up to
``LEXICON_LIMIT`` learned names are broadcast; more are joined, as a table, with the names that each
text may hold, with the same result.

Defined results: null and empty texts give no rows; placeholders replace exactly the found spans and
all other text stays; repeated rows give their details again; an empty table gives no rows; very long
texts cost time in proportion to their length; extra columns aren't read.
"""

from __future__ import annotations

import bisect
import itertools
import math
import random
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.session import materialise, spread

TYPES = ("email", "phone", "id_number", "address", "name")
#: Most learned names that are broadcast.
LEXICON_LIMIT = 500_000
#: Longest segment, in code points.
LONGEST = 160

_LOCAL = r"[\w.+%-]*\w"
_AT = r"(?:@|\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?)"
_DOT = r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?)"
_HOST = rf"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:{_DOT}[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+"
_EMAIL = re.compile(rf"(?:\{{\s*[\w.+-]+(?:\s*[,;|]\s*[\w.+-]+)+\s*\}}|(?<![\w.+%-])[A-Za-z0-9_][A-Za-z0-9_.+%-]*){_AT}{_HOST}", re.I | re.A)
_PHONE = re.compile(
    r"(?<![\w.+/-])(?:"
    r"(?P<intl>\+\d{1,3}[ .-]?(?:\(0\)[ ]?)?\d{1,5}(?:[ .-]?\d{2,5}){1,4})"
    r"|(?P<us>(?:\(\d{3}\)\s?|\d{3}[-. ])\d{3}[-. ]\d{4})"
    r"|(?P<uk>0\d{2,4} \d{3,4} ?\d{3,4}|0\d{4} \d{6})"
    r"|(?P<fr>0\d(?:[ .]\d{2}){4})"
    r")(?![\w-]|\.\d)", re.A)
_ID = re.compile(
    r"(?<![\w.+/-])(?:"
    r"(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<nino>[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z])"
    r"|(?P<dni>\d{8}-?[A-Z])"
    r"|(?P<nie>[XYZ]-?\d{7,8}-?[A-Z])"
    r"|(?P<prc>\d{17}[\dXx])"
    r")(?![\w-]|\.\d)", re.A)
_CAP = r"(?:[A-ZÀ-Þ][a-zß-ÿ'’]+|[A-ZÀ-Þ]{2,})"
_TOWN = rf"{_CAP}(?:[ -]{_CAP})?"
_KIND = r"(?:(?:Road|Street|Lane|Drive|Avenue|Boulevard|Court|Square|Terrace|Close|Way|Place|Row|ROAD|STREET|LANE|DRIVE|AVENUE|AVE)\b|(?:Ave|Blvd|Rd|St)\b\.?)"
_ADDRESS = re.compile(
    r"(?<![\w.-])(?:"
    rf"(?P<en>\d{{1,5}}[A-Za-z]?,? {_CAP}(?:[ -]{_CAP})? {_KIND}(?:, (?:Flat|Apt\.?|Unit|Suite) \w+)?(?:, {_TOWN}(?: \d{{4,6}})?)?)"
    rf"|(?P<fr>\d{{1,5}},? (?:bis |ter )?(?:rue|avenue|boulevard|place|chemin|allée|quai) (?:de la |de l'|du |des |de )?{_TOWN}(?:, \d{{4,6}} {_TOWN})?)"
    rf"|(?P<de>[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|weg|gasse|platz|allee|ring|damm) \d{{1,4}}[a-z]?(?:, (?:\d{{4,6}} )?{_TOWN})?)"
    rf"|(?P<es>(?:Calle|Avenida|Plaza|Paseo|CALLE) (?:de (?:la )?)?{_TOWN},? \d{{1,4}}(?:, (?:\d{{4,6}} )?{_TOWN})?)"
    r")")
_PARTICLE = r"(?:(?:de|van|von|der|den|del|della|di|da|dos|du|la|le|ter|ten|bin|ibn|al|el|zu|af|av) )"
_FAMILY = rf"{_CAP}(?:-{_CAP})*"
_NAME = re.compile(
    r"(?=(?<![A-Za-zÀ-ɏ\d_.@-])(?:"
    rf"(?P<given>{_CAP}(?:-{_CAP})?)(?P<mid>(?: [A-Z]\.)*) {_PARTICLE}{{0,3}}(?P<family>{_FAMILY})"
    rf"|(?P<initials>(?:[A-Z]\.[ -]?){{1,3}}){_PARTICLE}{{0,3}}(?P<family2>{_FAMILY})"
    rf"|(?P<family3>(?:{_PARTICLE}{{1,3}})?{_FAMILY}), (?P<given3>{_CAP}(?: [A-Z]\.)*|(?:[A-Z]\. ?){{1,3}}(?!\w))"
    r")(?![A-Za-zÀ-ɏ\d_@-]))")
_CUE_PHONE = re.compile(r"(?:tel|tél|phone|fon|fax|mobile|cell|call|text|dial|ring|number|电话|電話|at|on|or|/|：|は)[\s.:,]*$", re.I)
_CUE_ID = re.compile(r"(?:id|identity|passport|social security|insurance|nummer|number|ausweis|身份证号|nif|dni|nie|/|：|:)[\s.:]*(?:no\.?|is)?\s*$", re.I)
_CUE_BAD = re.compile(r"(?:ISBN|DOI|doi|host|Build|Grant No\.|No\.|registration|preprint|ISSN|version|Vol\.|arXiv|trial)\s*[\w./-]*$")
_CUE_NAME = re.compile(r"(?:by|to|from|with|and|of|is|are|as|thanks?|thanked|dear|von|par|por|;|/|:|\(|Dr\.|Mr\.|Ms\.|Mrs\.|Prof\.)\s*$", re.I)
_COMMON = frozenset(
    "the a an in on at we our this that these it as for to with by from since across overall however moreover therefore although"
    " under during despite taken by few nobody one each participants readers reviewers recall der die das ein eine wir wie im viele"
    " el los las la le les une nous cette en une table figure section author contact kontakt mean data then reviewer what well"
    " similar well data no is are was does why where there das damit".split())
_ARTICLE = re.compile(r"(?<!\w)(?:the|a|an|this|that|each|every|our|der|die|das|ein|eine|le|la|les|un|une|el|los|las)$", re.I)

#: Centre of the Gaussian prior on the log-linear weights of the whole-span features.
PRIORS: dict[str, float] = {
    "email:bias": 3.0, "email:spelled": 0.5, "email:group": 0.5, "email:nodot": -8.0,
    "phone:bias": -0.5, "phone:intl": 2.5, "phone:us": 1.5, "phone:uk": 1.5, "phone:fr": 1.5, "phone:cue": 1.5, "phone:bad": -6.0, "phone:digits": 0.5,
    "id_number:bias": -0.5, "id_number:ssn": 2.0, "id_number:nino": 1.5, "id_number:dni": 1.5, "id_number:nie": 1.5, "id_number:prc": 1.5, "id_number:cue": 1.5, "id_number:bad": -6.0,
    "address:bias": 1.0, "address:town": 1.5, "address:code": 0.5, "address:length": 0.01,
    "name:bias": -4.0, "name:given": 3.0, "name:family": 2.5, "name:initials": 2.0, "name:reversed": -0.5, "name:cue": 0.8, "name:inside": 1.2,
    "name:common": -6.0, "name:title_m": -4.0, "name:abbr": -6.0, "name:length": 0.02, "name:more": -2.0, "name:more_family": 2.5, "name:more_after_family": -1.0,
    "address:flat": 0.5, "address:cut": -1.0,
}

Span = tuple[int, int, str, dict[str, float]]


class Lexicon:
    """Given and family names in lower case."""

    def __init__(self, given: Iterable[str], family: Iterable[str]):
        self.given = {g.lower() for g in given}
        self.family = {f.lower() for f in family}


def _regex_spans(text: str, kind: str, pattern: re.Pattern, extra: Callable[[re.Match, dict], None]) -> Iterator[Span]:
    for m in pattern.finditer(text):
        feats = {f"{kind}:bias": 1.0}
        if m.lastgroup:
            feats[f"{kind}:{m.lastgroup}"] = 1.0
        extra(m, feats)
        yield m.start(), m.end(), kind, feats


def candidates(text: str, lexicon: Lexicon) -> list[Span]:
    """All candidate segments with their features."""

    def email(m: re.Match, f: dict) -> None:
        g = m.group()
        f["email:group"] = float(g[0] == "{")
        f["email:spelled"] = float(re.search(r"[(\[]", g) is not None)

    def phone(m: re.Match, f: dict) -> None:
        left = text[max(0, m.start() - 24) : m.start()]
        f["phone:cue"] = float(_CUE_PHONE.search(left) is not None)
        f["phone:bad"] = float(_CUE_BAD.search(left) is not None)
        f["phone:digits"] = float(9 <= sum(c.isdigit() for c in m.group()) <= 13)

    def number(m: re.Match, f: dict) -> None:
        left = text[max(0, m.start() - 28) : m.start()]
        f["id_number:cue"] = float(_CUE_ID.search(left) is not None)
        f["id_number:bad"] = float(_CUE_BAD.search(left) is not None)

    def address(m: re.Match, f: dict) -> None:
        f["address:town"] = float("," in m.group())
        f["address:code"] = float(re.search(r"\b\d{4,6}\b", m.group()) is not None)
        f["address:length"] = float(len(m.group()))
        f["address:flat"] = float(re.search(r", (?:Flat|Apt|Unit|Suite)\b", m.group()) is not None)

    out: list[Span] = []
    if "@" in text or re.search(r"[(\[{]\s?at\s?[)\]}]", text, re.I):
        out.extend(_regex_spans(text, "email", _EMAIL, email))
    out.extend(_regex_spans(text, "phone", _PHONE, phone))
    out.extend(_regex_spans(text, "id_number", _ID, number))
    for start, end, kind, feats in _regex_spans(text, "address", _ADDRESS, address):
        out.append((start, end, kind, feats))
        at = text.rfind(",", start, end)
        while at > start and any(c.isdigit() for c in text[start:at]) and any(c.isupper() for c in text[start:at]):
            part = text[start:at]  # the address may end before what stands behind a comma
            out.append((start, at, kind, {**feats, "address:town": float("," in part), "address:code": float(re.search(r"\b\d{4,6}\b", part) is not None), "address:length": float(at - start), "address:cut": 1.0}))
            at = text.rfind(",", start, at)
    for m in _NAME.finditer(text):
        span = _name(text, m, lexicon)
        if span:
            out.append(span)
            longer = _longer(text, m, span, lexicon)
            if longer:
                out.append(longer)
    return [x for x in out if x[1] - x[0] <= LONGEST]


def _name(text: str, m: re.Match, lexicon: Lexicon) -> Span | None:
    f = {"name:bias": 1.0}
    if m["given"]:
        first, family, end = m["given"].lower(), m["family"].lower(), m.end("family")
        known = first in lexicon.given
        if not known and family not in lexicon.family:
            return None
        f["name:given"] = float(known)
        f["name:common"] = float(not known and first in _COMMON)
        f["name:inside"] = float(known and family not in lexicon.family and family not in _COMMON and _inside(text, m))
    elif m["initials"]:
        family, end = m["family2"].lower(), m.end("family2")
        f["name:initials"] = 1.0
        f["name:title_m"] = float(m["initials"].strip() == "M." and re.match(r"\s+(?:a|est|ont|avait|et)\b", text[end : end + 8]) is not None)
        f["name:abbr"] = float(re.search(r"(?:^|[\s(])[a-zäöü]\.\s?$", text[max(0, m.start() - 4) : m.start()]) is not None or family in _COMMON or m["initials"].strip() in ("U.S.", "U.K.", "E.U.", "U.N."))
    else:
        family, end = m["family3"].split(" ")[-1].lower(), m.end("given3")
        first = m["given3"].split(" ")[0].lower()
        known = first in lexicon.given
        initial = re.fullmatch(r"(?:[A-Z]\. ?){1,3}", m["given3"]) is not None
        if not known and not initial:
            return None
        f["name:given"], f["name:initials"], f["name:reversed"] = float(known), float(initial), 1.0
    start = next(m.start(g) for g in ("given", "initials", "family3") if m[g])
    f["name:family"] = float(family in lexicon.family or any(p in lexicon.family for p in family.split("-")))
    f["name:cue"] = float(_CUE_NAME.search(text[max(0, start - 16) : start]) is not None)
    f["name:length"] = float(end - start)
    return start, end, "name", f


_FURTHER = re.compile(rf" (?P<family>{_FAMILY})(?![A-Za-zÀ-ɏ\d_@-])")


def _longer(text: str, m: re.Match, span: Span, lexicon: Lexicon) -> Span | None:
    """The same name with one more family name, where a capitalised word follows."""
    start, end, kind, feats = span
    more = _FURTHER.match(text, end) if m["given"] or m["initials"] else None
    if not more:
        return None
    word = more["family"].lower()
    f = {**feats, "name:more": 1.0, "name:more_family": float(word in lexicon.family), "name:more_after_family": feats["name:family"]}
    f["name:length"] = float(more.end() - start)
    return start, more.end(), kind, f


def _inside(text: str, m: re.Match) -> bool:
    """Whether a given and a family name in title case stand inside a sentence, not behind an article."""
    if m["given"].isupper() or len(m["family"]) < 3 or m["family"].isupper():
        return False
    left = text[max(0, m.start() - 24) : m.start()].rstrip(" \t")
    return bool(left) and left[-1] not in ".!?:。！？\n" and _ARTICLE.search(left) is None


def score(features: dict[str, float], weights: dict[str, float]) -> float:
    return sum(weights.get(k, 0.0) * v for k, v in features.items())


def decode(spans: list[Span], weights: dict[str, float]) -> list[Span]:
    """The best set of segments without overlap; everything else has score 0.

    Semi-Markov dynamic programming over the ends of segments; equal scores prefer the earlier start.
    """
    scored = [(e, s, k, f, score(f, weights)) for s, e, k, f in spans]
    scored = sorted((x for x in scored if x[4] > 0), key=lambda x: (x[0], x[1], x[2]))
    ends = [x[0] for x in scored]
    best, choice = [0.0], []
    for i, (_, s, _, _, v) in enumerate(scored):
        lo, hi = 0, i
        while lo < hi:  # segments that end at or before s
            mid = (lo + hi) // 2
            if ends[mid] <= s:
                lo = mid + 1
            else:
                hi = mid
        take = best[lo] + v
        choice.append(lo if take > best[i] else -1)
        best.append(max(take, best[i]))
    out, i = [], len(scored)
    while i:
        if choice[i - 1] < 0:
            i -= 1
        else:
            e, s, k, f, _ = scored[i - 1]
            out.append((s, e, k, f))
            i = choice[i - 1]
    return out[::-1]


def find(text: str, lexicon: Lexicon, weights: dict[str, float] | None = None) -> list[tuple[int, int, str]]:
    """Personal details ``(start, end, type)`` of one text in order."""
    return [(s, e, k) for s, e, k, _ in decode(candidates(text, lexicon), weights or PRIORS)]


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with typed placeholders in place of the spans."""
    out, at = [], 0
    for s, e, k in spans:
        out.extend((text[at:s], f"[{k.upper()}]"))
        at = e
    return "".join((*out, text[at:]))


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


def marginals(spans: list[Span], scores: list[float]) -> tuple[list[float], float]:
    """Probability of each segment and the log of the partition function over all sets without overlap."""
    n = len(spans)
    by_end = sorted(range(n), key=lambda k: (spans[k][1], spans[k][0]))
    by_start = sorted(range(n), key=lambda k: -spans[k][0])
    ends, starts = [spans[k][1] for k in by_end], [-spans[k][0] for k in by_start]
    ahead, behind = [0.0], [0.0]
    for k in by_end:
        ahead.append(_log_add(ahead[-1], ahead[bisect.bisect_right(ends, spans[k][0])] + scores[k]))
    for k in by_start:
        behind.append(_log_add(behind[-1], behind[bisect.bisect_right(starts, -spans[k][1])] + scores[k]))
    z = ahead[-1]
    out = [math.exp(ahead[bisect.bisect_right(ends, s)] + v + behind[bisect.bisect_right(starts, -e)] - z) for (s, e, *_), v in zip(spans, scores, strict=True)]
    return out, z


def fit(rows: Iterable[tuple[str, list[tuple[int, int, str]]]], lexicon: Lexicon, start: dict[str, float] | None = None, steps: int = 80, most_rows: int = 20_000, prior: float = 0.05) -> dict[str, float]:
    """Weights of highest posterior over at most ``most_rows`` labelled rows.

    Log-likelihood of the labelled sets of segments less ``prior`` times the squared distance from
    ``start``; ascent with step sizes that shrink with each weight's past gradients.
    """
    data = []
    for text, gold in itertools.islice(rows, most_rows):
        spans = candidates(text, lexicon)
        if spans:
            wanted = {tuple(x) for x in gold}
            data.append((spans, [float((s, e, k) in wanted) for s, e, k, _ in spans]))
    centre = dict(start or {})
    names = sorted({name for spans, _ in data for *_, f in spans for name in f} | set(centre))
    place = {name: k for k, name in enumerate(names)}
    x = np.zeros((sum(len(spans) for spans, _ in data), len(names)))
    truth, row = np.zeros(len(x)), 0
    for spans, gold in data:
        for (*_, f), g in zip(spans, gold, strict=True):
            for name, v in f.items():
                x[row, place[name]] = v
            truth[row] = g
            row += 1
    scale = np.array([0.05 if name.endswith(":length") else 1.0 for name in names])
    x *= scale
    mean = np.array([centre.get(name, 0.0) for name in names]) / scale
    weights, seen = mean.copy(), np.full(len(names), 1e-6)
    for _ in range(steps):
        scores = (x @ weights).tolist()
        chance, row = np.zeros(len(x)), 0
        for spans, _ in data:
            chance[row : row + len(spans)] = marginals(spans, scores[row : row + len(spans)])[0]
            row += len(spans)
        slope = x.T @ (truth - chance) - 2 * prior * (weights - mean)
        seen += slope * slope
        weights += slope / np.sqrt(seen)
    return {name: float(w) for name, w in zip(names, weights * scale, strict=True)}


_TRAIN_GIVEN = ("Asta", "Milan", "Petra", "Grant", "May", "Ove", "Lina", "Tomas", "Hope", "Ravi", "Ilka", "Kofi")
_TRAIN_FAMILY = ("Holmgard", "Verrazon", "Quistorp", "Arkwell", "Belmondy", "Tarnsworth", "Odunlade", "Szarka")
#: Family names that no lexicon lists.
_TRAIN_OTHER = ("Veltmeer", "Ockham-Tye", "Brannoch")
_TRAIN = (
    "Questions go to {name} at {email}.", "{name}, {address}, phone {phone}", "Her passport number is {id_number}.", "Our gratitude is due to {name}, {name} and {name}.",
    "{name}; {name}", "The parcel went from {address} to {address}.", "Dial {phone} or use {email} instead.", "Identity no. {id_number} was copied from the card of {name}.",
    "Dear {name}, your letter of March reached us.", "We met {name} in the second week.", "In the archive {given} {o} found the letters.", "Copies were kept by {given} {o} for years.",
    "Prof. {f} spoke in the U.S. {f} et al. disagreed.", "M. {f} a donné son accord.", "See ISBN 978-1-234-{n}456-7 or DOI 10.1234/x.1999.{n}.",
    "Version 3.12.{n}.9 runs on host 198.51.100.{n}.", "Paid from Grant No. QX-11-20{n}-31 and trial 2019-0{n}.", "The Decision Tree was grown in {n} steps ({f}, 2014).",
    "Logged on 2017-11-02 18:30:00 with recall @ 10.", "Grant holders met in the May Hall; St. {f} was the venue.", "The rate reader@task was 2.{n} (see 444) on the Mill Road set.",
    "Hope remained. May we ask? Will it work? {f} (2009) doubts it.", "The Grant Office is closed. Hope Lane is open, as is the May Workshop.", "{name} ({email}) answers on {phone}.",
    "Send it to {address}.", "Unsere Anschrift ist {address}; Telefon {phone}.", "Personal record: {name}, {id_number}, {address}.", "{f} and {f} [{n}] compare readers; cf. {f}, {n} and Table {n}.",
    "Approved by {name} and {name}.", "{name} {name_next} both signed.", "arXiv preprint 1901.0{n}2 and Vol. {n}, No. 4, pp. 100-1{n}.", "Page Layout and Text Entry were tested by Group {n}.",
    "Author: {name} Although the room was dark, we read on.", "Editor: {name}; {name} Across the hall they typed.", "{name} Thanks go to all.", "Signed: {name} Readers came in pairs.",
)


def training_rows(n: int = 480, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled sentences made from templates with invented names; at most ``n``."""
    rng = random.Random(seed)

    def value(kind: str) -> str:
        g, f, d = rng.choice(_TRAIN_GIVEN), rng.choice(_TRAIN_FAMILY), rng.randint
        return rng.choice({
            "name": (f"{g} {f}", f"{g} {chr(d(65, 90))}. {f}", f"{f}, {g}", f"{chr(d(65, 76))}. {f}", f"{g.upper()} {f.upper()}", f"{g} van {f}", f"{g} {f} {rng.choice(_TRAIN_FAMILY)}"),
            "email": (f"{g}.{f}@lab.example".lower(), f"{f} (at) uni.example".lower(), f"{{{g},{f}}}@x.example".lower(), f"{g} [at] a [dot] example".lower()),
            "phone": (f"({d(200, 999)}) 555-0{d(100, 199)}", f"+49 30 {d(10000, 99999)} {d(100, 999)}", f"07700 900{d(100, 999)}", f"01 99 00 {d(10, 99)} {d(10, 99)}"),
            "id_number": (f"9{d(10, 99)}-{d(10, 99)}-{d(1000, 9999)}", f"QQ{d(100000, 999999)}C", f"{d(10000000, 99999999)}-T", f"X{d(1000000, 9999999)}Z"),
            "address": (f"{d(1, 250)} Harbor Road, Milltown {d(10000, 99999)}", f"Hafenstraße {d(1, 99)}, {d(10000, 99999)} Milltown", f"{d(1, 99)}, rue Harbor, {d(10000, 99999)} Milltown", f"Calle Harbor {d(1, 99)}, Milltown",
                        f"{d(1, 90)} Orchard Lane, Flat {d(1, 9)}, Milltown", f"{d(1, 90)} Orchard Lane"),
        }[kind])

    rows = []
    for k in range(n):
        text, gold = "", []
        for part in re.split(r"(\{given\} \{o\}|\{\w+\})", _TRAIN[k % len(_TRAIN)]):
            kind = "name" if part == "{name_next}" else "unknown" if part == "{given} {o}" else part.strip("{}")
            if part.startswith("{") and kind in (*TYPES, "unknown"):
                v = f"{rng.choice(_TRAIN_GIVEN)} {rng.choice(_TRAIN_OTHER)}" if kind == "unknown" else value(kind)
                if part == "{name_next}":
                    text = text.rstrip() + " and "
                gold.append((len(text), len(text) + len(v), "name" if kind == "unknown" else kind))
                text += v
            else:
                text += {"{f}": rng.choice(_TRAIN_FAMILY), "{n}": str(rng.randint(10, 99))}.get(part, part)
        rows.append((text, gold))
    return rows


@cache
def _trained() -> tuple[tuple[str, float], ...]:
    return tuple(fit(training_rows(), Lexicon(_TRAIN_GIVEN, _TRAIN_FAMILY), PRIORS).items())


def trained() -> dict[str, float]:
    """Weights fitted on ``training_rows``; made once in a driver."""
    return dict(_trained())


# ---- Spark ------------------------------------------------------------------------------------

_PAIR = r"(?=(?<![\p{L}.@-])(\p{Lu}\p{Ll}+(?: \p{Lu}\.)* \p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)*)(?![\p{L}@-]))"


def name_lexicon(documents: DataFrame, given: DataFrame) -> Lexicon | DataFrame:
    """Names learned from all texts; a table ``(kind, word)`` where they are more than ``LEXICON_LIMIT``."""
    pairs = (documents.where("text IS NOT NULL")
             .select(F.explode(F.regexp_extract_all("text", F.lit(_PAIR), F.lit(1))).alias("p"))
             .select(F.regexp_extract("p", r"^\S+", 0).alias("g"), F.regexp_extract("p", r"\S+$", 0).alias("f"))
             .distinct())
    pairs = materialise(pairs)
    listed = given.where("given_name IS NOT NULL").select(F.col("given_name").alias("g")).distinct()

    def sure(by: str, known: DataFrame, other: str, kinds: int, share: float) -> DataFrame:
        """Words of which enough distinct partners, in number and in share, are known."""
        own = F.col("_known").isNotNull()
        marked = pairs.join(known.select(other, F.lit(True).alias("_known")), other, "left")
        sums = marked.groupBy(by).agg(F.count("*").alias("all"), F.sum(own.cast("int")).alias("own"))
        return sums.where((F.col("own") >= kinds) & (F.col("own") >= share * F.col("all"))).select(by)

    family = sure("f", listed, "g", 2, 0.2)
    more = sure("g", family, "f", 3, 0.05)
    words = family.select(F.lit("f").alias("kind"), F.col("f").alias("word")).unionByName(
        more.unionByName(listed).distinct().select(F.lit("g").alias("kind"), F.col("g").alias("word")))
    words = materialise(words.select("kind", F.lower("word").alias("word")).where(~((F.col("kind") == "g") & F.col("word").isin(sorted(_COMMON)))).distinct())
    if words.count() > LEXICON_LIMIT:
        return words
    rows = words.collect()
    return Lexicon([r["word"] for r in rows if r["kind"] == "g"], [r["word"] for r in rows if r["kind"] == "f"])


FOUND = "doc_id long, pii string, start_pos int, end_pos int"
_NAME_WORD = r"(?=(?<![\p{L}\d])(\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)*))"


def _with_names(texts: DataFrame, lexicon: Lexicon | DataFrame) -> DataFrame:
    """The texts with the learned names that they may hold in ``given`` and ``family``; null where the lexicon is broadcast."""
    if isinstance(lexicon, Lexicon):
        none = F.lit(None).cast("array<string>")
        return spread(texts.withColumn("given", none).withColumn("family", none), "doc_id")
    whole = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_NAME_WORD), F.lit(1)), F.lower)))
    held = texts.where("text IS NOT NULL").select("doc_id", whole.alias("word"))
    # a compound name is also looked up by its parts
    parts = held.unionByName(held.where("word LIKE '%-%'").select("doc_id", F.explode(F.split("word", "-")).alias("word"))).distinct()
    names = parts.join(lexicon, "word").groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("kind") == "g", F.col("word"))).alias("given"), F.collect_set(F.when(F.col("kind") == "f", F.col("word"))).alias("family"))
    empty = F.array().cast("array<string>")
    return (texts.join(names, "doc_id", "left").withColumn("given", F.coalesce("given", empty)).withColumn("family", F.coalesce("family", empty)))


Look = Callable[[str, object, object], list[tuple[int, int, str]]]


def _finder(spark: SparkSession, lexicon: Lexicon | DataFrame) -> Callable[[], Look]:
    """Makes, in a task, what finds the details of a text with the broadcast lexicon or the names that came with the text.

    Plain sets are broadcast: unlike functions, objects of this package's classes need it on the executors.
    """
    names = (frozenset(lexicon.given), frozenset(lexicon.family)) if isinstance(lexicon, Lexicon) else None
    shared = spark.sparkContext.broadcast((names, trained()))

    def make() -> Look:
        known, weights = shared.value
        own = None if known is None else Lexicon(*known)
        return lambda text, given, family: find(text, Lexicon(given, family) if own is None else own, weights)

    return make


def details(documents: DataFrame, lexicon: Lexicon | DataFrame) -> DataFrame:
    """One row per personal detail; see ``FOUND``."""
    finder = _finder(documents.sparkSession, lexicon)

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = finder()
        for pdf in parts:
            rows = [(d, k, s, e) for d, t, g, f in pdf.itertuples(index=False) for s, e, k in look(t, g, f)]
            yield pd.DataFrame(rows, columns=["doc_id", "pii", "start_pos", "end_pos"])

    texts = documents.where("text IS NOT NULL AND text <> ''").select("doc_id", "text")
    return _with_names(texts, lexicon).select("doc_id", "text", "given", "family").mapInPandas(batches, FOUND)


def redacted(documents: DataFrame, lexicon: Lexicon | DataFrame) -> DataFrame:
    """``(doc_id, text)`` with placeholders."""
    finder = _finder(documents.sparkSession, lexicon)

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = finder()
        for pdf in parts:
            rows = [(d, None if t is None else redact(t, look(t, g, f))) for d, t, g, f in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["doc_id", "text"])

    return _with_names(documents.select("doc_id", "text"), lexicon).select("doc_id", "text", "given", "family").mapInPandas(batches, "doc_id long, text string")


def found(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "pii", "start_pos")
