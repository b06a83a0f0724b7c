"""Which chunks are not worth rewriting, as column expressions. White space around a chunk does not count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions import constants as C

# What headings, equations, placeholders and citation keys look like.
HEADING = r"^\s{0,3}#{1,6}\s+\S"
BOLD = r"^\s*\*\*[^*\n]{1,120}\*\*\s*$"
NUMBERED = r"^\s*(?:[A-Z]\.|\d+\.)+\d*\s+[A-Z]"
TITLE_WORD = r"[A-Za-z0-9][A-Za-z0-9\-]*"
SYMBOL = r"[=|_\\/*+\-()]"
FORMULA = r"(?:\b[A-Za-z]+_[A-Za-z]+\b|\b[A-Za-z]\([^)]*\)|\bsum\(|\bprod(?:uct)?\b|\b[DQMP]_[A-Z]+\b)"
MATH = r"\[MATH_\d{3}\]"
PURE_MATH = r"^\s*(?:\[MATH_\d{3}\](?:\s*(?:,|and|or)?\s*)?)+[.:;]?\s*$"
MATH_NOTE = r"(?i)^\s*(?:where|here|with)\s+\[MATH_\d{3}\]\b"
CITATION_KEY = r"^[A-Za-z]+\d{4}[a-z]?$"
LINE_BREAK = r"^\s*\\{1,2}\s*$"
LONGEST_TITLE, TITLE_WORDS, LONGEST_EQUATION, MATH_SHARE, SHORT_WORD = 120, 12, 220, 0.4, 30


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def title_like(t: Column) -> Column:
    short = F.length(t) <= LONGEST_TITLE
    words = hits(t, TITLE_WORD)
    phrase = (words > 0) & (words <= TITLE_WORDS) & ~t.rlike(r"[.!?]$") & t.contains(":") & short
    return (t != "") & ~t.contains("\n") & (t.rlike(HEADING) | t.rlike(BOLD) | (t.rlike(NUMBERED) & short) | phrase)


def math_heavy(t: Column, placeholders: Column | None = None) -> Column:
    """`placeholders`: the chunk's number of them, where it is known; else they are counted in the text."""
    known = hits(t, MATH) if placeholders is None else F.when(placeholders > 0, placeholders).otherwise(hits(t, MATH))
    held = F.length(t) - F.length(F.regexp_replace(t, MATH, ""))
    return (known > 0) & (t.rlike(PURE_MATH) | ((F.length(t) <= LONGEST_TITLE) & t.rlike(MATH_NOTE)) | (held / F.length(t) > MATH_SHARE))


def equation_like(t: Column) -> Column:
    symbols, markers, equals = hits(t, SYMBOL), hits(t, FORMULA), t.contains("=")
    some = (equals & (symbols >= 4)) | ((markers >= 2) & (symbols >= 3)) | (~t.contains("\n") & equals & (markers >= 1))
    return (t != "") & (F.length(t) <= LONGEST_EQUATION) & some


def latex_fragment(t: Column) -> Column:
    return (t != "") & (t.rlike(LINE_BREAK) | t.rlike(CITATION_KEY) | (~t.contains(" ") & (F.length(t) < SHORT_WORD)))


def skip_reason(text: Column, placeholders: Column | None = None, min_prose: int = C.MIN_PROSE) -> Column:
    """The first reason that holds, or null."""
    t = stripped(text)
    out = F.when((t == "") | (F.length(t) < min_prose), "too_short").when(latex_fragment(t), "latex_fragment").when(title_like(t), "title_like")
    return out.when(math_heavy(t, placeholders), "math_heavy").when(equation_like(t), "equation_like")
