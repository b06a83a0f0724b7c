"""What is made of a language model's numbers: arrays of token log-probabilities, sentence losses and window scores, each in its row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import let, mean, total

#: Tokens that a sentence needs to count, and sentences (or values) that a statistic needs.
MIN_TOKENS, MIN_SENTENCES, MIN_VALUES = 10, 3, 2


def moments(values: Column) -> Column:
    """Struct of mean, std, skewness and excess kurtosis in their population forms; the latter two are 0 without spread."""

    def around(m: Column) -> Column:
        power = lambda k: F.aggregate(values, F.lit(0.0), lambda a, x: a + F.pow(x - m, F.lit(float(k)))) / F.size(values)
        return let(F.struct(power(2).alias("two"), power(3).alias("three"), power(4).alias("four")), lambda p: shape(m, p))

    def shape(m: Column, p: Column) -> Column:
        spread = p["two"] > 0
        skew = F.when(spread, p["three"] / F.pow(p["two"], F.lit(1.5))).otherwise(0.0)
        kurtosis = F.when(spread, p["four"] / (p["two"] * p["two"]) - 3.0).otherwise(0.0)
        return F.struct(m.alias("mean"), F.sqrt(p["two"]).alias("std"), skew.alias("skewness"), kurtosis.alias("kurtosis"))

    return F.when(F.size(values) > 0, let(total(values) / F.size(values), around))


def quantile(values: Column, share: float) -> Column:
    """A quantile with linear interpolation between the neighbours."""

    def of(s: Column) -> Column:
        place = (F.size(s) - 1) * F.lit(share)
        low = F.get(s, F.floor(place).cast("int"))
        high = F.get(s, F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    return F.when(F.size(values) > 0, let(F.sort_array(values), of))


def sentence_losses(losses: Column, tokens: Column) -> Column:
    """Struct of mean, std, min and max over the losses of sentences with enough tokens; null for fewer than three of them."""
    kept = F.filter(F.zip_with(losses, tokens, lambda x, n: F.when(n >= MIN_TOKENS, x)), lambda x: x.isNotNull())
    stats = let(kept, lambda k: F.when(F.size(k) >= MIN_SENTENCES, let(moments(k), lambda m: F.struct(m["mean"], m["std"], F.array_min(k).alias("min"), F.array_max(k).alias("max")))))
    return stats


def tail_ratio(log_probs: Column) -> Column:
    """The share of the values below their own tenth percentile; null for fewer than two."""
    share = let(quantile(log_probs, 0.1), lambda q: F.size(F.filter(log_probs, lambda x: x < q)) / F.size(log_probs))
    return F.when(F.size(log_probs) >= MIN_VALUES, share)


def token_distribution(log_probs: Column) -> Column:
    """Struct of mean_log_prob, std_log_prob, skewness, kurtosis and tail_ratio, the share below the own tenth percentile; null for fewer than two."""
    stats = let(moments(log_probs), lambda m: F.struct(m["mean"].alias("mean_log_prob"), m["std"].alias("std_log_prob"), m["skewness"].alias("skewness"), m["kurtosis"].alias("kurtosis"), tail_ratio(log_probs).alias("tail_ratio")))
    return F.when(F.size(log_probs) >= MIN_VALUES, stats)


def cross_perplexity(observer: Column, performer: Column, ids: Column) -> Column:
    """Perplexity of a text under one model, over the cross-perplexity of two: from their logits at each token, and the tokens' ids.

    The logits at a token say what follows it, so the last one's are not used. Logarithms of sums of exponentials are taken around the
    greatest logit. Positions whose logits are missing or of different numbers, or whose id has none, are left out; null if none is left;
    1 if the cross-perplexity is 0.
    """
    dot = lambda v, f: F.aggregate(v, F.lit(0.0), lambda s, x: s + f(x))

    def position(p: Column) -> Column:
        o, q = p["o"], p["q"]
        log_sum = lambda v, top: top + F.ln(dot(v, lambda x: F.exp(x - top)))
        sums = let(F.struct(F.array_max(o).alias("o"), F.array_max(q).alias("q")), lambda top: F.struct(log_sum(o, top["o"]).alias("o"), log_sum(q, top["q"]).alias("q")))
        crossed = lambda s: F.aggregate(F.zip_with(q, o, lambda x, y: F.exp(x - s["q"]) * (s["o"] - y)), F.lit(0.0), lambda a, x: a + x)
        return let(sums, lambda s: F.struct((s["o"] - F.get(o, p["id"])).alias("own"), crossed(s).alias("cross")))

    number = F.least(F.size(observer), F.size(performer), F.size(ids)) - 1
    doubles = lambda v: F.transform(v, lambda x: x.cast("double"))
    rows = F.transform(F.sequence(F.lit(0), number - 1), lambda i: F.struct(doubles(F.get(observer, i)).alias("o"), doubles(F.get(performer, i)).alias("q"), F.get(ids, i + 1).cast("int").alias("id")))
    whole = F.filter(rows, lambda p: (F.size(p["o"]) == F.size(p["q"])) & (p["id"] >= 0) & (p["id"] < F.size(p["o"])))
    found = F.transform(whole, position)
    sums = F.aggregate(found, F.struct(F.lit(0.0).alias("own"), F.lit(0.0).alias("cross"), F.lit(0).alias("n")), lambda a, x: F.struct((a["own"] + x["own"]).alias("own"), (a["cross"] + x["cross"]).alias("cross"), (a["n"] + 1).alias("n")))
    ratio = let(sums, lambda s: F.when(s["n"] == 0, None).when(s["cross"] == 0, 1.0).otherwise(s["own"] / s["cross"]))
    return F.when(number > 0, ratio)


def window_score(scores: Column) -> Column:
    """The score of a text from those of its windows: their mean."""
    return mean(scores)


def top_label(scores: Column) -> Column:
    """The label with the highest score in an array of (label, score); the first one of equals."""
    return F.aggregate(scores, F.get(scores, 0), lambda best, x: F.when(x["score"] > best["score"], x).otherwise(best))["label"]


def generation_size(words: Column) -> Column:
    """Tokens that a rewrite of so many words may take."""
    return F.greatest(F.lit(512), F.least(F.lit(2048), F.floor(words * 2 * F.lit(1.3)))).cast("int")


def duration_text(seconds: Column) -> Column:
    """Seconds as 3.2s, 4m 5.0s or 1h 2m 3.0s."""
    rest = F.format_string("%.1fs", seconds - F.floor(seconds / 60) * 60)
    minutes = F.floor(seconds / 60).cast("long")
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).when(seconds < 3600, F.concat(F.format_string("%dm ", minutes), rest)).otherwise(F.concat(F.format_string("%dh %dm ", F.floor(minutes / 60).cast("long"), minutes % 60), rest))


def with_confidence(detections, calibration, score: str = "score"):
    """Adds confidence, the calibrated score, and the version of the calibration that gave it. `calibration` has method, version and parameters."""
    return detections.withColumn("confidence", calibrated(F.col(score), calibration.method, calibration.parameters)).withColumn("calibration_version", F.lit(calibration.version))


def calibrated(score: Column, method: str, parameters: dict) -> Column:
    """A score under a saved calibration. Thresholds by slice leave it as it is: they change the decision only."""
    from loomtext.functions import scoring

    if method == "temperature_scaling":
        return scoring.temperature_scaled(score, parameters.get("temperature", 1.0))
    if method == "isotonic":
        return scoring.interpolated(score, [tuple(p) for p in parameters.get("breakpoints", [])])
    if method == "slice_thresholds":
        return score
    raise ValueError(f"unknown calibration method: {method}")
