"""The lexicon of rhetorical cues and its matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roots and aliases (fixed values).
LEXICON: dict[str, tuple[str, ...]] = {
    "we": ("our", "present study", "this paper", "this work", "this research"),
    "previous": ("previously", "recent", "recently"),
    "thus": ("therefore",),
    "aim": ("objective", "goal", "purpose", "objectives", "goals", "purposes"),
    "question": ("questions", "hypothesis", "hypotheses"),
    "investigate": ("explore", "study", "test", "examine", "evaluate", "assess", "determine", "characterize", "analyze", "report", "seek"),
    "use": ("employ",),
    "method": ("algorithm", "assay"),
    "observe": ("we see", "find", "show"),
    "conclude": ("conclusion", "summarize", "summary"),
    "suggest": ("illustrate", "demonstrate", "imply", "indicate", "confirm", "reflect", "support", "prove", "reveal"),
    "because": ("result from", "attribute to"),
    "likely": ("probable", "probably", "possible", "possibly", "may", "could"),
    "need": ("remain",),
    "future": ("further",),
    "consistent": ("match", "agree", "support", "in line", "in agreement", "similar", "same", "analogous"),
    "inconsistent": ("conflicting", "conflict", "contrast", "contrary", "differ", "different", "difference", "unlike"),
    "than": ("compare",),
    "however": ("other hand", "although", "though", "but", "while", "despite"),
    "extend": ("extension", "extends"),
    "contribution": ("contributions", "contribute", "contributes"),
}


def terms(*roots: str) -> list[str]:
    """Roots and their aliases in lexicon order; a word that is no root stands for itself."""
    return [t for r in roots for t in (r, *LEXICON.get(r, ()))]


def pattern(*roots: str) -> str:
    """One alternation for all terms of the roots, longest first."""
    return r"\b(?:" + "|".join(sorted(terms(*roots), key=lambda t: (-len(t), t))) + r")\b"


def matches(text: Column, *roots: str) -> Column:
    """Whether a sentence has a term of the roots; the text is lower-cased once by the caller."""
    return text.rlike(pattern(*roots))


def found_terms(text: Column, *roots: str) -> Column:
    """All terms found, in lexicon order; a term of two roots may come twice."""
    return F.filter(F.array(*[F.when(text.rlike(rf"\b{t}\b"), t) for t in terms(*roots)]), lambda t: t.isNotNull())
