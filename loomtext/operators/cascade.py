"""Evaluation of rewrites in stages, and the choice among candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import constants as C


# The profiles that trade speed for quality.
PROFILES = ("fast", "balanced", "quality")


def nli_passes(forward: Column, backward: Column, both: bool) -> Column:
    no = (forward == "contradiction") | (backward == "contradiction")
    a, b = forward == "entailment", backward == "entailment"
    return ~no & ((a & b) if both else (a | b))


def nli_reason(forward: Column, backward: Column, both: bool) -> Column:
    labels = F.format_string("forward=%s, backward=%s", forward, backward)
    no = (forward == "contradiction") | (backward == "contradiction")
    text = "NLI bidirectional entailment required but got " if both else "NLI relaxed mode requires entailment in at least one direction but got "
    return F.when(no, F.concat(F.lit("NLI detected contradiction ("), labels, F.lit(")"))).otherwise(F.concat(F.lit(text), labels))


def evaluated(rows: DataFrame, similarity: float = 0.65, both: bool = False, f1: float | None = None) -> DataFrame:
    """Adds passed, stage and rejection_reason; scores of stages after the failing one become null.

    Needs the columns term_reason (null if terms are kept), similarity, nli_forward, nli_backward and, if f1 is given, bertscore_f1.
    The scores are columns; where they come from an expensive model, score only the rows that `pending` leaves for its stage.
    """
    terms = F.col("term_reason").isNull()
    close = terms & (F.col("similarity") >= similarity)
    entails = close & nli_passes(F.col("nli_forward"), F.col("nli_backward"), both)
    good = entails & (F.col("bertscore_f1") >= f1) if f1 is not None else entails
    stage = F.when(~terms, "terms").when(~close, "similarity").when(~entails, "nli").when(~good, "bertscore").otherwise("passed")
    reason = F.when(~terms, F.col("term_reason")).when(~close, F.format_string("embedding similarity %.3f below threshold %.2f", F.col("similarity"), F.lit(similarity)))
    reason = reason.when(~entails, nli_reason(F.col("nli_forward"), F.col("nli_backward"), both))
    if f1 is not None:
        reason = reason.when(~good, F.format_string("BERTScore F1 %.3f below threshold %.2f", F.col("bertscore_f1"), F.lit(f1)))
    out = rows.withColumn("passed", good).withColumn("stage", stage).withColumn("rejection_reason", reason)
    out = out.withColumn("similarity", F.when(terms, F.col("similarity")))
    out = out.withColumn("nli_forward", F.when(close, F.col("nli_forward"))).withColumn("nli_backward", F.when(close, F.col("nli_backward")))
    return out.withColumn("bertscore_f1", F.when(entails, F.col("bertscore_f1"))) if f1 is not None else out


def evaluated_for(rows: DataFrame, profile: str, f1: float, similarity: float = 0.65, both: bool = False) -> DataFrame:
    """`evaluated` as a quality profile (fast, balanced or quality) asks for it: token vectors are compared for quality only."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}; there are {', '.join(PROFILES)}")
    return evaluated(rows, similarity, both, f1 if profile == "quality" else None)


def evaluation_summary(results: DataFrame, *by: str) -> DataFrame:
    """Per group: number of rewrites, share that passed, least, mean and greatest of the scores that are there, and how often each forward
    entailment label occurs."""
    scores = [c for c in ("similarity", "bertscore_f1") if c in results.columns]
    numbers = [f(c).alias(f"{c}_{n}") for c in scores for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))]
    out = results.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), *numbers)
    counts = results.filter("nli_forward is not null").groupBy(*by, "nli_forward").agg(F.count("*").alias("n"))
    labels = counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("nli_forward", "n")))).alias("labels"))
    same = F.lit(True)
    for k in by:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out.join(labels.withColumnsRenamed({k: f"_{k}" for k in by}), same, "left").drop(*[f"_{k}" for k in by])  # one row per group each


def pending(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key has no result yet: for one stage of a run that is taken up again."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def echoes(text: Column) -> Column:
    """Whether a rewrite repeats its instructions."""
    flat = F.regexp_replace(F.lower(text), r"\s+", " ")
    return F.exists(F.array(*[F.lit(p) for p in C.ECHOES]), lambda p: F.contains(flat, p))


def gate(text: Column, similarity: Column, floor: float, semantic: float) -> Column:
    """The first gate that stops a candidate, or null."""
    return F.when(echoes(text), "prompt_echo").when(similarity < floor, "hard_floor").when(similarity < semantic, "semantic_gate")


def keeps_original(placeholders: Column, math: Column, length: Column, failures: Column, aborted: Column) -> Column:
    return ((math >= 1) & (length <= 220)) | (placeholders >= 5) | (failures >= 5) | (aborted & (failures > 0))


OPERATORS = ("STANDARD", "RESTRUCTURE", "VOICE_SHIFT", "VOCABULARY", "REORDER")


def operator_for(iteration: Column, placeholders: Column, math: Column, failures: Column) -> Column:
    """The rewrite operator of an iteration: round robin over a list that shrinks with placeholders and failures.

    More than five placeholders set two operators whatever the formulas said, as the rules are applied in that order.
    """
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    by_math = F.when(math > 1, names("STANDARD")).when(math > 0, names("STANDARD", "RESTRUCTURE")).otherwise(names(*OPERATORS))
    some = F.when(placeholders > 5, names("STANDARD", "RESTRUCTURE")).when(placeholders > 3, F.array_remove(by_math, "REORDER")).otherwise(by_math)
    few = F.when(failures >= 4, names("STANDARD")).when(failures >= 2, F.filter(some, lambda o: o.isin("STANDARD", "RESTRUCTURE"))).otherwise(some)
    return F.get(few, F.pmod(iteration, F.size(few)))


def preferred(candidate: Column, best: Column) -> Column:
    """Whether one (score, sim) struct beats another: clearly more similar, else above the floor, else lower score, else more similar."""
    s, t = F.coalesce(candidate["sim"], F.lit(0.0)), F.coalesce(best["sim"], F.lit(0.0))
    up, down = candidate["score"] >= C.SCORE_FLOOR, best["score"] >= C.SCORE_FLOOR
    same = F.when(candidate["score"] != best["score"], candidate["score"] < best["score"]).otherwise(s > t)
    return F.when(s > t + C.PRIORITY_MARGIN, True).when(t > s + C.PRIORITY_MARGIN, False).when(up == down, same).otherwise(up & ~down)


def chosen(candidates: Column, target: float = 0.35) -> Column:
    """The winner of an array of (iteration, score, sim), in order.

    The first one between the floor and the target ends the search and wins; else the best so far wins. The preference is not
    transitive, so it is folded in order and cannot be a sort key.
    """
    ordered = F.array_sort(candidates)
    early = F.filter(ordered, lambda c: (c["score"] >= C.SCORE_FLOOR) & (c["score"] < target))
    best = F.aggregate(ordered, F.get(ordered, 0), lambda b, c: F.when(preferred(c, b), c).otherwise(b))
    return F.when(F.size(early) > 0, F.get(early, 0)).otherwise(best)
