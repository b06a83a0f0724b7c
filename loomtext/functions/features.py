"""Linguistic features of each text and the score that combines them. A feature that cannot be computed is null, never 0.

Features stay within their rows: words, n-grams and sentences are arrays, so no text is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import constants as C
from loomtext.functions import signals, tags
from loomtext.functions import text as T


def with_words(docs: DataFrame, rules: bool = False) -> DataFrame:
    """Adds words, sents (the words of each sentence) and lens (their numbers). With `rules`, abbreviations and the like do not end sentences."""
    text = F.coalesce("text", F.lit(""))
    sentences = tags.rule_sentences(text) if rules else T.sentences(text)
    # No word goes on beyond a sentence's end, so the words of the text are those of its sentences, and are looked for once.
    docs = docs.withColumn("sents", F.transform(sentences, T.words)).withColumn("words", F.flatten("sents"))
    return docs.withColumn("lens", F.transform("sents", lambda s: F.size(s).cast("double")))


def lexical(docs: DataFrame) -> DataFrame:
    """style_ttr and style_hapax_ratio."""
    docs = docs.withColumn("_ordered", F.sort_array(T.hashed(F.col("words")))).withColumn("_again", T.repeats(F.col("_ordered")))
    n = F.size("_ordered")
    distinct = n - F.size("_again")
    docs = docs.withColumn("style_ttr", F.when(n > 0, distinct / n))
    return docs.withColumn("style_hapax_ratio", F.when(n > 0, (distinct - F.size(F.array_distinct("_again"))) / n)).drop("_ordered", "_again")


def function_words(docs: DataFrame) -> DataFrame:
    """function_word_entropy and style_function_word_divergence (Kullback-Leibler, against HUMAN_SHARES)."""
    names = F.array(*[F.lit(w) for w in C.FUNCTION_WORDS])
    shares = F.map_from_arrays(names, F.array(*[F.lit(C.HUMAN_SHARES[w]) for w in C.FUNCTION_WORDS]))
    docs = docs.withColumn("_hits", F.filter("words", lambda w: w.isin(*C.FUNCTION_WORDS)))
    docs = docs.withColumn("_hits", F.sort_array("_hits")).withColumn("_names", F.array_distinct("_hits"))
    docs = T.with_counts(docs, F.col("_hits"), "_n")
    n, e = F.size("_hits"), F.lit(C.EPSILON)
    ok = (F.size("words") >= C.MIN_WORDS) & (n > 0)
    ent = F.aggregate("_n", F.lit(0.0), lambda a, c: a - (c / n) * F.log2(c / n + e))
    # Words without a hit add e * ln(e / (share + e)) each: all of them, less those with hits.
    none = sum(C.EPSILON * math.log(C.EPSILON / (q + C.EPSILON)) for q in C.HUMAN_SHARES.values())
    share = lambda i: F.element_at(shares, F.get(F.col("_names"), i)) + e
    parts = F.transform("_n", lambda c, i: (c / n + e) * F.ln((c / n + e) / share(i)) - e * F.ln(e / share(i)))
    docs = docs.withColumn("function_word_entropy", F.when(ok, ent))
    docs = docs.withColumn("style_function_word_divergence", F.when(ok, F.lit(none) + T.total(parts)))
    return docs.drop("_hits", "_names", "_n")


def sentence_shape(docs: DataFrame) -> DataFrame:
    """sentence_length_mean, struct_sentence_length_variance and struct_symmetry_score."""
    lens = F.col("lens")
    docs = docs.withColumn("sentence_length_mean", T.mean(lens)).withColumn("struct_sentence_length_variance", T.variance(lens))
    ratio = F.sqrt("struct_sentence_length_variance") / F.col("sentence_length_mean")
    ok = (F.size(lens) >= C.MIN_SENTENCES) & (F.col("sentence_length_mean") > 0)
    return docs.withColumn("struct_symmetry_score", F.when(ok, 1 - F.least(F.lit(1.0), ratio)))


def paragraph_variance(text: Column) -> Column:
    """Variance of the paragraphs' numbers of full-stop parts; null for fewer than two paragraphs."""
    parts = F.filter(F.split(text, "\n\n"), lambda p: p.rlike(r"\S"))
    return F.when(F.size(parts) > 1, T.variance(F.transform(parts, lambda p: F.size(F.split(F.regexp_replace(p, r"^\s+|\s+$", ""), r"\.")).cast("double"))))


def discourse(docs: DataFrame) -> DataFrame:
    """disc_bigram_entropy, disc_trigram_rarity and disc_sentence_entropy_variance."""
    docs = docs.withColumn("_one", T.hashed(F.col("words")))
    docs = docs.withColumn("_two", T.neighbours(F.col("_one"), F.col("_one"))).withColumn("_three", T.neighbours(F.col("_two"), F.col("_one")))
    for name in ("_two", "_three"):
        docs = docs.withColumn(name, F.sort_array(name)).withColumn(f"{name}_again", T.repeats(F.col(name)))
    ok = F.size("words") >= 6
    docs = docs.withColumn("disc_bigram_entropy", F.when(ok, T.entropy_of(F.size("_two"), F.col("_two_again"))))
    kinds = F.size("_three") - F.size("_three_again")
    docs = docs.withColumn("disc_trigram_rarity", F.when(ok, (kinds - F.size(F.array_distinct("_three_again"))) / F.greatest(kinds, F.lit(1))))
    docs = docs.withColumn("_ent", F.transform(F.filter("sents", lambda s: F.size(s) > 0), T.entropy))
    some = (F.size("sents") >= C.MIN_SENTENCES) & (F.size("_ent") >= C.MIN_SENTENCES)
    docs = docs.withColumn("sentence_entropy_mean", F.when(some, T.mean(F.col("_ent"))))
    docs = docs.withColumn("disc_sentence_entropy_variance", F.when(some, T.variance(F.col("_ent"))))
    return docs.drop("_one", "_two", "_three", "_two_again", "_three_again", "_ent")


def transitions(docs: DataFrame) -> DataFrame:
    """disc_transition_density (per 1000 words) and disc_transition_diversity; both 0 if a long enough text has none."""
    docs = docs.withColumn("_low", F.lower(F.coalesce("text", F.lit(""))))
    # Most texts hold few of the phrases, and looking for one takes less than counting it.
    count = lambda p: F.when(F.contains(F.col("_low"), F.lit(p)), (F.length("_low") - F.length(F.replace(F.col("_low"), F.lit(p), F.lit("")))) / len(p))
    found = T.let(F.filter(F.array(*[count(p) for p in C.TRANSITIONS]), lambda c: c.isNotNull()), lambda c: F.struct(T.total(c).alias("n"), F.size(c).alias("kinds")))
    docs = docs.withColumn("_found", found)
    n, ok = F.col("_found.n"), F.size("words") >= C.MIN_WORDS
    docs = docs.withColumn("disc_transition_density", F.when(ok, n / F.size("words") * 1000))
    docs = docs.withColumn("disc_transition_diversity", F.when(ok, F.when(n > 0, F.col("_found.kinds") / n).otherwise(0.0)))
    return docs.drop("_low", "_found")


def tagged(docs: DataFrame, tag: str = "tags", relation: str | None = None, head: str | None = None) -> DataFrame:
    """disc_pos_trigram_entropy from a column of tags; with relations and heads also clause_density_mean and style_clause_density_variance."""
    # Each sort stands in a column of its own: inside a lambda Spark would compare boxed numbers.
    docs = docs.withColumn("_names", T.hashed(F.col(tag))).withColumn("_runs", tags.tag_runs(F.col("_names")))
    docs = docs.withColumn("disc_pos_trigram_entropy", F.when(F.size("words") >= 6, tags.run_entropy(F.col("_runs")))).drop("_names", "_runs")
    if relation is None or head is None:
        return docs
    docs = docs.withColumn("_top", tags.roots(F.col(head))).withColumn("_places", tags.clause_places(F.col(tag), F.col(relation), F.col("_top")))
    docs = docs.withColumn("_clauses", tags.clause_shape(F.col("_top"), F.col("_places"))).drop("_top", "_places")
    return docs.withColumn("clause_density_mean", F.col("_clauses.mean")).withColumn("style_clause_density_variance", F.col("_clauses.variance")).drop("_clauses")


def modelled(docs: DataFrame, losses: str | None = None, loss_tokens: str | None = None, log_probs: str | None = None) -> DataFrame:
    """What a language model's columns give: lm_perplexity_mean and lm_burstiness from the losses of sentences and their numbers of tokens,
    lm_token_prob_tail_ratio from the log-probabilities of tokens."""
    if losses is not None and loss_tokens is not None:
        docs = docs.withColumn("_losses", signals.sentence_losses(F.col(losses), F.col(loss_tokens)))
        docs = docs.withColumn("lm_perplexity_mean", F.col("_losses.mean")).withColumn("lm_burstiness", F.col("_losses.std")).drop("_losses")
    if log_probs is not None:
        docs = docs.withColumn("lm_token_prob_tail_ratio", signals.tail_ratio(F.col(log_probs)))
    return docs


NATIVE = (
    "style_ttr", "style_hapax_ratio", "style_function_word_divergence", "struct_sentence_length_variance", "struct_symmetry_score",
    "disc_sentence_entropy_variance", "disc_bigram_entropy", "disc_trigram_rarity", "disc_transition_density", "disc_transition_diversity",
)
#: All features that enter the score, in its order. Those that need columns of a tagger, parser or model are left out where these are not given.
SCORED = tuple(C.BOUNDS)


def features(docs: DataFrame, rules: bool = False, tag: str | None = None, relation: str | None = None, head: str | None = None, losses: str | None = None, loss_tokens: str | None = None, log_probs: str | None = None) -> DataFrame:
    """The features of each document: those that need no model, and with the named columns those of a tagger, a parser and a language model."""
    docs = with_words(docs, rules)
    for step in (lexical, function_words, sentence_shape, discourse, transitions):
        docs = step(docs)
    if tag is not None:
        docs = tagged(docs, tag, relation, head)
    return modelled(docs, losses, loss_tokens, log_probs)


def normalized(name: str, value: Column) -> Column:
    """A feature on [0, 1], 1 for machine-like; null if the feature is."""
    low, high, invert = C.BOUNDS[name]
    if low == high:
        return F.when(value.isNotNull(), F.lit(0.5))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    return F.when(value.isNotNull(), 1 - part if invert else part)


def combined(names=NATIVE) -> Column:
    """Mean of the normalized features that are there; 0.5 if none is."""
    there = F.filter(F.array(*[normalized(n, F.col(n)) for n in names]), lambda x: x.isNotNull())
    return F.coalesce(T.mean(there), F.lit(0.5))


def stat_score(docs: DataFrame, **columns) -> DataFrame:
    """Adds stat_score, null for texts of fewer than 50 words, from the features that the columns (see `features`) allow."""
    enough = F.size(T.spaced(F.coalesce("text", F.lit("")))) >= C.MIN_WORDS
    docs = features(docs, **columns)
    return docs.withColumn("stat_score", F.when(enough, combined([n for n in SCORED if n in docs.columns])))
