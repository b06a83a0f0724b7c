"""Ensemble, classes, calibration and explanations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions import constants as C
from loomtext.functions.features import normalized
from loomtext.functions.text import let, total


def ensemble(scores: list[Column], weights: tuple) -> Column:
    """Weighted mean of the scores that are there; the first one if their weights are not positive."""
    there = [F.when(s.isNotNull(), F.lit(float(w))).otherwise(0.0) for s, w in zip(scores, weights, strict=True)]
    parts = [F.coalesce(s, F.lit(0.0)) * w for s, w in zip(scores, there, strict=True)]
    weight, value = there[0], parts[0]
    for w, p in zip(there[1:], parts[1:]):
        weight, value = weight + w, value + p
    return F.when(weight > 0, value / weight).otherwise(scores[0])


def label(score: Column, human_max: float = C.HUMAN_MAX, ai_min: float = C.AI_MIN) -> Column:
    return F.when(score <= human_max, "human").when(score >= ai_min, "ai_generated").when(score.isNotNull(), "ambiguous")


def needs_third_tier(first: Column, second: Column, always: bool = False, human_max: float = C.HUMAN_MAX, ai_min: float = C.AI_MIN) -> Column:
    """Whether the expensive tier should score a text: its partial ensemble lies strictly between the thresholds."""
    partial = ensemble([first, second], C.WEIGHTS)
    return F.lit(True) if always else (partial > human_max) & (partial < ai_min)


def cross_score(raw: Column) -> Column:
    """A cross-perplexity ratio on [0, 1]. exp overflows to infinity, so no guard is needed."""
    return 1 / (1 + F.exp((raw - C.CROSS_THRESHOLD) * C.CROSS_SCALE))


def softmax(logits: Column) -> Column:
    raised = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return let(raised, lambda r: let(total(r), lambda t: F.transform(r, lambda x: x / t)))


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), score))


def temperature_scaled(score: Column, temperature: Column | float) -> Column:
    s = clamped(score)
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return 1 / (1 + F.exp(-F.ln(s / (1 - s)) / t))


def interpolated(score: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through the points, flat beyond them; the score itself if there are none."""
    if not points:
        return score
    out = F.when(score <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        if x1 > x0:
            out = out.when(score <= x1, y0 + (score - x0) * ((y1 - y0) / (x1 - x0)))
    return out.when(score.isNotNull(), F.lit(float(points[-1][1])))


def explanations(names) -> Column:
    """Array of (feature, raw, normalized, direction, description, category), most machine-like first, ties in the features' order."""
    rows = []
    for place, name in enumerate(names):
        norm = normalized(name, F.col(name))
        row = F.struct(
            (-norm).alias("by"), F.lit(place).alias("place"), F.lit(name).alias("feature"), F.col(name).alias("raw"), norm.alias("normalized"),
            F.when(norm > 0.5, "ai_like").otherwise("human_like").alias("direction"), F.lit(C.DESCRIPTIONS[name]).alias("description"), F.lit(C.CATEGORIES[name.split("_")[0]]).alias("category"),
        )
        rows.append(F.when(norm.isNotNull(), row))
    return F.sort_array(F.filter(F.array(*rows), lambda x: x.isNotNull()))


def summary(kind: Column, found: Column) -> Column:
    """One sentence about the class, the number of machine-like features and the three strongest."""
    many = F.size(F.filter(found, lambda x: x["direction"] == "ai_like"))
    top = F.array_join(F.transform(F.slice(found, 1, 3), lambda x: F.concat(F.lower(x["description"]), F.lit(" ("), F.replace(x["direction"], F.lit("_"), F.lit("-")), F.lit(")"))), ", ")
    full = F.format_string("Text classified as %s. %d of %d features indicate AI-generated content. Top signals: %s.", kind, many, F.size(found), top)
    return F.when(F.size(found) > 0, full).otherwise(F.format_string("Text classified as %s with no feature details available.", kind))
