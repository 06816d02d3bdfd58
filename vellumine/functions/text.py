"""Scalar text expressions; all stay in whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Strip all white space, not only blanks as ``trim`` does."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_sentence(c: Column) -> Column:
    """Drop what isn't ASCII, mend ``- `` breaks, strip; in this order."""
    return strip(F.replace(F.regexp_replace(c, r"[^\x00-\x7F]", ""), F.lit("- "), F.lit("")))


def any_contains(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


# Substrings that tell what a section is about (fixed values).
SECTION_WORDS = {
    "introduction": ("introduction",),
    "conclusion": ("conclusion", "concluding"),
    "discussion": ("discussion",),
    "related_work": ("related work", "background", "relatedwork"),
    "future_work": ("future work",),
    "result": ("result", "evaluation", "finding", "study", "experiment"),
    "method": ("method", "system"),
}


def is_section(section: Column, name: str) -> Column:
    """Whether a section's path mentions the topic; null sections don't."""
    return F.coalesce(any_contains(F.lower(section), SECTION_WORDS[name]), F.lit(False))


def expected_section(section: Column, label: str) -> Column:
    """Whether sentences with ``label`` are to be expected in the section."""
    where = {
        "Contribution": ("introduction",), "Objective": ("introduction", "conclusion"), "Novelty": ("related_work", "introduction"),
        "Result": ("introduction", "result", "discussion", "conclusion"), "Conclusion": ("conclusion", "discussion"),
        "Future Work": ("introduction", "conclusion", "discussion", "future_work"),
    }
    if label == "Method":
        return ~reduce(lambda a, b: a | b, [is_section(section, s) for s in ("related_work", "result", "future_work", "discussion")])
    return reduce(lambda a, b: a | b, [is_section(section, s) for s in where.get(label, ())], F.lit(False))


def media_type(caption: Column) -> Column:
    low = F.lower(caption)
    return F.when(low.contains("fig.") | low.contains("figure"), "figure").when(low.contains("tab.") | low.contains("table"), "table").otherwise("")


def section_number(header: Column) -> Column:
    """First number of a header with at most one period, or the empty string."""
    return F.regexp_extract(header, r"[-+]?\d*\.\d+|\d+", 0)


def strict_section_number(header: Column) -> Column:
    """Whole dotted number at the start of a header."""
    return F.regexp_extract(header, r"^\d+(\.\d+)*", 0)


def author_statement(text: Column) -> Column:
    """A sentence that speaks of its authors: the word we or our, or this paper."""
    low = F.lower(text)
    return F.arrays_overlap(F.split(low, r"\s+"), F.array(F.lit("we"), F.lit("our"))) | low.contains("this paper")


def starts_upper(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}")


def clean_font(c: Column) -> Column:
    """Without the tags of font subsets."""
    return F.regexp_replace(c, r"(\S{6})\+", "")


def normal_label(c: Column) -> Column:
    return F.initcap(F.element_at(F.split(c, "_"), 1))


def token_or_null(c: Column) -> Column:
    """A token stripped of outer punctuation, in lower case."""
    return F.lower(F.regexp_replace(c, r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", ""))


def display_type(c: Column) -> Column:
    return F.coalesce(F.initcap(c), F.lit("Not Used"))


def red_green_blue(hex_colour: Column) -> Column:
    """``#rrggbb`` as an array of three numbers."""
    return F.array(*[F.conv(F.substring(hex_colour, k, 2), 16, 10).cast("int") for k in (2, 4, 6)])


def drop_suffix(name: Column, suffix: str) -> Column:
    """Remove a file's suffix, as a suffix and not as a set of characters."""
    return F.when(name.endswith(suffix), name.substr(F.lit(1), F.char_length(name) - len(suffix))).otherwise(name)
