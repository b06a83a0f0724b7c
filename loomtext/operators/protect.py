"""Terms that a rewrite must keep: found by patterns, replaced by placeholders, checked, repaired and put back.

Choosing spans is greedy by priority and numbering goes from the right, so protection is an Arrow function over rows; checking and
restoring are column functions.
"""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Citations as (Author, Year) and the like, numbers, capitalized phrases, placeholders.
CITATIONS = (
    r"\[([A-Z][a-zA-Z\s&]+(?:,\s*[A-Z][a-zA-Z\s&]+)*,\s*\d{4}[a-z]?)\]",
    r"\(([A-Z][a-zA-Z\s]+\s+et\s+al\.,\s*\d{4}[a-z]?)\)",
    r"\(([A-Z][a-zA-Z\s&]+(?:,\s*[A-Z][a-zA-Z\s&]+)*,\s*\d{4}[a-z]?)\)",
    r"([A-Z][a-zA-Z]+(?:\s+(?:and|&)\s+[A-Z][a-zA-Z]+)?)\s+\((\d{4}[a-z]?)\)",
)
NUMBER = r"\b\d+(?:\.\d+)?%?\b"
PHRASE = r"\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)+\b"
PLACEHOLDER = r"\[(?:MATH|TERM)_(\d{3})\]"


#: Kinds of entities that are protected.
ENTITIES = ("ORG", "PERSON", "GPE", "PRODUCT")


def spans(text: str, terms: tuple[str, ...], entities=()) -> list[tuple[int, int, int]]:
    """(priority, start, end) of what could be protected, in the order in which it is considered; numbers only where there are no formulas.

    entities are (start, end, label) that were found elsewhere; they come after citations and before terms.
    """
    patterns = [(4, rf"\b{re.escape(t)}\b", re.I) for t in terms]
    if "[MATH_" not in text:
        patterns.append((5, NUMBER, 0))
    patterns.append((6, PHRASE, 0))
    found = lambda some: [(rank, m.start(), m.end()) for rank, p, flags in some for m in re.finditer(p, text, flags)]
    named = sorted((start, end) for start, end, label in entities if label in ENTITIES and 0 <= start < end - 1 and end <= len(text))
    return found([(2, p, 0) for p in CITATIONS]) + [(3, start, end) for start, end in named] + found(patterns)


def protected(text: str, terms: tuple[str, ...], most: int, entities=()) -> tuple[str, dict[str, str]]:
    """The text with placeholders and what they stand for; `most` of them, all if 0. Numbers go on from the formulas' highest one."""
    taken = [(m.start(), m.end()) for m in re.finditer(PLACEHOLDER, text)]  # in order, and free of overlaps
    math = [int(n) for n in re.findall(r"\[MATH_(\d{3})\]", text)]
    chosen: list[tuple[int, int, int]] = []
    for rank, start, end in spans(text, terms, entities):
        at = bisect.bisect_left(taken, (start, end))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
            taken.insert(at, (start, end))
            chosen.append((rank, start, end))
    limit = max(2, most - len(set(math))) if math and most else most
    if limit:
        chosen = sorted(chosen)[:limit]
    number, found = max(math, default=-1) + 1, {}
    pieces, stop = [], len(text)
    for _, start, end in sorted(chosen, key=lambda c: -c[1]):
        name, number = f"[TERM_{number:03d}]", number + 1
        found[name] = text[start:end]
        pieces += [text[end:stop], name]
        stop = start
    return text[:stop] + "".join(reversed(pieces)), found


def protect(text: Column, terms: tuple[str, ...] = (), most: int = 10, entities: Column | None = None) -> Column:
    """Struct of the protected text and the map of placeholders. `entities` is an array of (start, end, label) in code points."""

    @F.pandas_udf("struct<text:string,terms:map<string,string>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([protected(t or "", terms, most) for t in texts], columns=["text", "terms"])

    @F.pandas_udf("struct<text:string,terms:map<string,string>>")
    def run_with(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        named = [[] if e is None else [(x["start"], x["end"], x["label"]) for x in e] for e in found]
        return pd.DataFrame([protected(t or "", terms, most, e) for t, e in zip(texts, named, strict=True)], columns=["text", "terms"])

    return run(text) if entities is None else run_with(text, entities)


def with_entities(docs: DataFrame, entities: DataFrame, *keys: str, into: str = "entities") -> DataFrame:
    """docs with the array of their entities (start, end, label) from a table of them; those of other kinds and of one letter are left out."""
    some = entities.filter(F.col("label").isin(*ENTITIES) & (F.col("end") - F.col("start") > 1))
    found = some.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias(into))
    return docs.join(found, list(keys), "left")


def lost(terms: Column, text: Column) -> Column:
    """Placeholders that a text lacks, in order."""
    return F.array_sort(F.filter(F.map_keys(terms), lambda k: ~F.contains(text, k)))


def restored(text: Column, terms: Column, strict: bool = True) -> Column:
    """The text with its terms back, longest placeholder first; if strict, one that remains is an error."""
    entries = F.array_sort(F.map_entries(terms), lambda a, b: F.length(b["key"]) - F.length(a["key"]))
    out = F.aggregate(entries, text, lambda t, e: F.replace(t, e["key"], e["value"]))
    return F.when(out.rlike(PLACEHOLDER), F.raise_error(F.concat(F.lit("placeholders remain: "), out))).otherwise(out) if strict else out


def repaired(text: Column, terms: Column) -> Column:
    """The text in which a lost placeholder takes the first place where its original stands: as it is, in other case, or else with other
    spaces and hyphens between its words."""

    def put(t: Column, e: Column) -> Column:
        name, value = e["key"], e["value"]
        words = F.filter(F.split(value, r"[\s\-]+"), lambda w: w != "")
        loose = F.concat(F.lit("(?iuU)"), F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"([^\w\s])", r"\\$1")), r"[\s\-]+"))
        cut = lambda at, size: F.concat(F.substring(t, F.lit(1), at - 1), name, F.substring(t, at + size, F.length(t)))
        exact, folded, flexible = F.instr(t, value), F.instr(F.lower(t), F.lower(value)), F.regexp_instr(t, loose)
        return (
            F.when(F.contains(t, name), t).when(exact > 0, cut(exact, F.length(value))).when(folded > 0, cut(folded, F.length(value)))
            .when((F.size(words) > 1) & (flexible > 0), cut(flexible, F.length(F.regexp_substr(t, loose)))).otherwise(t)
        )

    return F.aggregate(F.map_entries(terms), text, put)
