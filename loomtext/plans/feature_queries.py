"""Queries over documents' features, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import constants as C
from loomtext.functions import features as X
from loomtext.functions import scoring as S
from loomtext.plans import sql as Q


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rounded(df: DataFrame, *names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


def ttr_hapax(spark, sf_dir):
    df = X.lexical(X.with_words(documents(spark, sf_dir)))
    return df.select("doc_id", F.size("words").cast("long").alias("n_words"), *rounded(df, "style_ttr", "style_hapax_ratio"))


def sentence_stats(spark, sf_dir):
    df = X.sentence_shape(X.with_words(documents(spark, sf_dir)))
    return df.select("doc_id", F.size("lens").cast("long").alias("n_sentences"), *rounded(df, "sentence_length_mean", "struct_sentence_length_variance", "struct_symmetry_score"))


def paragraph_variance(spark, sf_dir):
    # The documents break lines, not paragraphs: each break counts as one.
    df = documents(spark, sf_dir).withColumn("v", X.paragraph_variance(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))))
    return df.select("doc_id", F.round("v", 6).alias("paragraph_length_variance"))


def function_word_kl(spark, sf_dir):
    df = X.function_words(X.with_words(documents(spark, sf_dir)))
    return df.select("doc_id", *rounded(df, "function_word_entropy", "style_function_word_divergence"))


def ngram_entropy(spark, sf_dir):
    df = X.discourse(X.with_words(documents(spark, sf_dir)))
    return df.select("doc_id", *rounded(df, "disc_bigram_entropy", "disc_trigram_rarity"))


def sentence_entropy(spark, sf_dir):
    df = X.discourse(X.with_words(documents(spark, sf_dir)))
    return df.select("doc_id", *rounded(df, "sentence_entropy_mean", "disc_sentence_entropy_variance"))


def transition_density(spark, sf_dir):
    df = X.transitions(X.with_words(documents(spark, sf_dir)))
    return df.select("doc_id", *rounded(df, "disc_transition_density", "disc_transition_diversity"))


def feature_vector(spark, sf_dir):
    df = X.features(documents(spark, sf_dir))
    return df.select("doc_id", *rounded(df, *X.NATIVE))


def stat_score(spark, sf_dir):
    df = X.stat_score(documents(spark, sf_dir))
    return df.select("doc_id", F.round("stat_score", 6).alias("stat_score"), S.label(F.round("stat_score", 6)).alias("classification"))


def classify_counts(spark, sf_dir):
    df = X.stat_score(documents(spark, sf_dir)).select("lang", S.label(F.round("stat_score", 6)).alias("classification"))
    return df.groupBy("lang", "classification").agg(F.count("*").alias("n"))


def explain_top3(spark, sf_dir):
    df = X.stat_score(documents(spark, sf_dir))
    for n in X.NATIVE:  # ranked by rounded values, so that ties are ties everywhere
        df = df.withColumn(n, F.round(n, 6))
    df = df.withColumn("found", S.explanations(X.NATIVE))
    top = F.posexplode(F.slice("found", 1, 3)).alias("at", "x")
    df = df.select("doc_id", top)
    return df.select("doc_id", (F.col("at") + 1).alias("rank"), F.col("x.feature").alias("feature"), F.round("x.normalized", 5).alias("normalized"), F.col("x.direction").alias("direction"), F.col("x.category").alias("category"))


def with_scores(spark, sf_dir) -> DataFrame:
    """Stand-ins for model scores: a classifier's from the text's hash, a cross-perplexity's for every third document."""
    df = X.stat_score(documents(spark, sf_dir))
    df = df.withColumn("first_score", (F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 6), 16, 10).cast("long") / 16777215.0))
    raw = F.when(F.col("doc_id") % 3 == 0, 0.7 + F.col("first_score") * 0.4)
    return df.withColumn("third_score", S.cross_score(raw))


def ensemble_missing_tier(spark, sf_dir):
    df = with_scores(spark, sf_dir)
    gate = S.needs_third_tier(F.col("first_score"), F.col("stat_score"))
    third = F.when(gate, F.col("third_score"))
    weights = F.when(third.isNotNull(), S.ensemble([F.col("first_score"), F.col("stat_score"), third], C.WEIGHTS_ALL)).otherwise(S.ensemble([F.col("first_score"), F.col("stat_score")], C.WEIGHTS))
    df = df.withColumn("ensemble_score", F.round(weights, 6))
    return df.select("doc_id", F.round("first_score", 6).alias("first_score"), gate.alias("gated"), F.round(third, 6).alias("third_score"), "ensemble_score", S.label(F.col("ensemble_score")).alias("classification"))


def base_sql() -> str:
    """CTEs up to `feats`, one row per document with all features."""
    fw = ", ".join(f"('{w}', {C.HUMAN_SHARES[w]})" for w in C.FUNCTION_WORDS)
    trans = " + ".join(f"[(length(low) - length(replace(low, '{p}', ''))) // {len(p)}]" for p in C.TRANSITIONS).replace(" + ", " || ")
    e = C.EPSILON
    return f"""
with d as (select doc_id, lang, coalesce(text, '') t, lower(coalesce(text, '')) low, {Q.words()} words, {Q.spaced()} spaced,
    list_transform({Q.sentences()}, lambda s: {Q.words('s')}) sents from documents),
w as (select doc_id, unnest(words) w from d),
wc as (select doc_id, w, count(*) c from w group by all),
lex as (select doc_id, count(*) kinds, sum(c) n, count(*) filter (c = 1) once from wc group by 1),
shares(w, q) as (values {fw}),
hits as (select doc_id, sum(c) n from wc join shares using (w) group by 1),
fw as (
  select h.doc_id, -sum(case when c > 0 then c / h.n * log2(c / h.n + {e}) else 0 end) ent, sum((coalesce(c, 0) / h.n + {e}) * ln((coalesce(c, 0) / h.n + {e}) / (q + {e}))) kl
  from hits h cross join shares left join wc on wc.doc_id = h.doc_id and wc.w = shares.w group by 1),
two as (select doc_id, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) g from d),
twoc as (select doc_id, g, count(*)::double c from two group by all),
twoe as (select doc_id, -sum(c / n * log2(c / n)) ent from (select *, sum(c) over (partition by doc_id) n from twoc) group by 1),
three as (select doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) g from d),
threec as (select doc_id, g, count(*) c from three group by all),
threer as (select doc_id, count(*) filter (c = 1)::double / count(*) rarity from threec group by 1),
sent as (select doc_id, unnest(range(1, len(sents) + 1)) k, unnest(sents) s from d),
sentw as (select doc_id, k, unnest(s) w from sent),
sentc as (select doc_id, k, w, count(*)::double c from sentw group by all),
sente as (select doc_id, k, -sum(c / n * log2(c / n)) ent from (select *, sum(c) over (partition by doc_id, k) n from sentc) group by all),
sentv as (select doc_id, count(*) n, avg(ent) m, var_pop(ent) v from sente group by 1),
shape as (select doc_id, count(*) n, avg(len(s)) m, var_pop(len(s)) v from sent group by 1),
tr as (select doc_id, list_filter({trans}, lambda c: c > 0) f from d),
feats as (
  select d.doc_id, d.lang, len(words) n_words, len(spaced) n_spaced, len(sents) n_sentences,
    kinds::double / lex.n style_ttr, once::double / lex.n style_hapax_ratio,
    case when len(words) >= {C.MIN_WORDS} then fw.ent end function_word_entropy, case when len(words) >= {C.MIN_WORDS} then fw.kl end style_function_word_divergence,
    shape.m sentence_length_mean, shape.v struct_sentence_length_variance,
    case when shape.n >= {C.MIN_SENTENCES} and shape.m > 0 then 1 - least(1, sqrt(shape.v) / shape.m) end struct_symmetry_score,
    case when shape.n >= {C.MIN_SENTENCES} and sentv.n >= {C.MIN_SENTENCES} then sentv.m end sentence_entropy_mean,
    case when shape.n >= {C.MIN_SENTENCES} and sentv.n >= {C.MIN_SENTENCES} then sentv.v end disc_sentence_entropy_variance,
    case when len(words) >= 6 then twoe.ent end disc_bigram_entropy, case when len(words) >= 6 then threer.rarity end disc_trigram_rarity,
    case when len(words) >= {C.MIN_WORDS} then coalesce(list_sum(f), 0) / len(words) * 1000 end disc_transition_density,
    case when len(words) >= {C.MIN_WORDS} then case when len(f) > 0 then len(f) / list_sum(f) else 0 end end disc_transition_diversity
  from d left join lex using (doc_id) left join fw using (doc_id) left join twoe using (doc_id) left join threer using (doc_id)
    left join sentv using (doc_id) left join shape using (doc_id) left join tr using (doc_id))"""


def norm_sql(name: str, value: str | None = None) -> str:
    low, high, invert = C.BOUNDS[name]
    value = value or name
    part = f"greatest(0.0::double, least(1.0::double, ({value} - {low}::double) / ({high}::double - {low}::double)))"
    return f"case when {value} is not null then {'1 - ' + part if invert else part} end"


def score_sql() -> str:
    norms = "[" + ", ".join(norm_sql(n) for n in X.NATIVE) + "]"
    return base_sql() + f""",
scored as (
  select *, case when n_spaced >= {C.MIN_WORDS} then coalesce(list_avg(list_filter({norms}, lambda x: x is not null)), 0.5) end stat_score from feats)"""


def label_sql(score: str) -> str:
    return f"case when {score} <= {C.HUMAN_MAX} then 'human' when {score} >= {C.AI_MIN} then 'ai_generated' when {score} is not null then 'ambiguous' end"


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0::double {n}" for n in names)


def oracle_sql() -> dict[str, str]:
    base, score = base_sql(), score_sql()
    rows = " union all ".join(f"select doc_id, {i} place, '{n}' feature, {norm_sql(n, f'round({n}, 6)')} x, '{C.CATEGORIES[n.split('_')[0]]}' category from feats" for i, n in enumerate(X.NATIVE))
    first = "(('0x' || substr(md5(doc_id::varchar), 1, 6))::bigint / 16777215.0::double)"
    return {
        "ttr_hapax": base + f" select doc_id, n_words, {r6('style_ttr', 'style_hapax_ratio')} from feats",
        "sentence_stats": base + f" select doc_id, n_sentences, {r6('sentence_length_mean', 'struct_sentence_length_variance', 'struct_symmetry_score')} from feats",
        "paragraph_variance": r"""
with p as (select doc_id, unnest(list_filter(string_split(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda p: regexp_matches(p, '\S'))) p from documents),
v as (select doc_id, count(*) n, var_pop(len(string_split(regexp_replace(p, '^\s+|\s+$', '', 'g'), '.'))) v from p group by 1)
select doc_id, case when n > 1 then round(v, 6) end paragraph_length_variance from documents left join v using (doc_id)""",
        "function_word_kl": base + f" select doc_id, {r6('function_word_entropy', 'style_function_word_divergence')} from feats",
        "ngram_entropy": base + f" select doc_id, {r6('disc_bigram_entropy', 'disc_trigram_rarity')} from feats",
        "sentence_entropy": base + f" select doc_id, {r6('sentence_entropy_mean', 'disc_sentence_entropy_variance')} from feats",
        "transition_density": base + f" select doc_id, {r6('disc_transition_density', 'disc_transition_diversity')} from feats",
        "feature_vector": base + f" select doc_id, {r6(*X.NATIVE)} from feats",
        "stat_score": score + f" select doc_id, round(stat_score, 6) stat_score, {label_sql('round(stat_score, 6)')} classification from scored",
        "classify_counts": score + f" select lang, {label_sql('round(stat_score, 6)')} classification, count(*) n from scored group by all",
        "explain_top3": base + f""" select doc_id, rank::int rank, feature, round(x, 5) normalized, case when x > 0.5 then 'ai_like' else 'human_like' end direction, category
from (select *, row_number() over (partition by doc_id order by x desc, place) rank from ({rows}) where x is not null) where rank <= 3""",
        "ensemble_missing_tier": score + f""",
tiers as (select doc_id, {first} a, stat_score b, case when doc_id % 3 = 0 then 1 / (1 + exp((0.7 + {first} * 0.4 - {C.CROSS_THRESHOLD}) * {C.CROSS_SCALE})) end c from scored),
gate as (select *, case when b is null then a else a * 0.7::double + b * 0.3::double end p from tiers),
gated as (select *, p > {C.HUMAN_MAX} and p < {C.AI_MIN} g, case when p > {C.HUMAN_MAX} and p < {C.AI_MIN} then c end k from gate),
mixed as (select *, round(case when k is null then p when b is null then (a * 0.4::double + k * 0.45::double) / 0.85::double else a * 0.4::double + b * 0.15::double + k * 0.45::double end, 6) e from gated)
select doc_id, round(a, 6) first_score, g gated, round(k, 6) third_score, e ensemble_score, {label_sql('e')} classification from mixed""",
    }


QUERIES = {f.__name__: f for f in (ttr_hapax, sentence_stats, paragraph_variance, function_word_kl, ngram_entropy, sentence_entropy, transition_density, feature_vector, stat_score, classify_counts, explain_top3, ensemble_missing_tier)}
