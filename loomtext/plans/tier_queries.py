"""Queries over tiers of scorers, token vectors, logits, tags and sentences by rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import constants as C
from loomtext.functions import features as X
from loomtext.functions import scoring as S
from loomtext.functions import signals, tags
from loomtext.functions import text as T
from loomtext.operators import alignment, tiers
from loomtext.plans import feature_queries as Q

VOWELS = "aeiouAEIOU"


def vowel_scores(weights: dict, texts: list[str]) -> list[tuple]:
    """A stand-in for a language model: the share of vowels as a cross-perplexity ratio."""
    import math

    out = []
    for t in texts:
        share = sum(t.count(v) for v in VOWELS) / len(t) if t else 0.0
        score = 1 / (1 + math.exp((weights["bias"] + weights["share"] * share - C.CROSS_THRESHOLD) * C.CROSS_SCALE))
        out.append((score, "ai_like" if score > 0.5 else "human_like", {"vowel_share": share}))
    return out


def vowel_weights() -> dict:
    return {"bias": 0.65, "share": 0.8}


VOWEL_SCORER = tiers.Scorer("third", vowel_weights, vowel_scores)


def first_scores(spark, sf_dir) -> DataFrame:
    docs = X.stat_score(Q.documents(spark, sf_dir))
    return docs.withColumn("first_score", F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 6), 16, 10).cast("long") / 16777215.0)


def gated_detection(spark, sf_dir):
    """All three tiers, with the third one in Python: only texts inside the gate reach it."""
    out = tiers.detected(first_scores(spark, sf_dir), VOWEL_SCORER).withColumn("ensemble_score", F.round("ensemble_score", 6))
    third = F.col("third")
    return out.select(
        "doc_id", "gated", F.round(third["score"], 6).alias("third_score"), third["label"].alias("third_label"), F.round(third["features"]["vowel_share"], 6).alias("vowel_share"),
        "ensemble_score", S.label(F.col("ensemble_score")).alias("classification"),
    )


def detector_records(spark, sf_dir):
    """Detection records of all documents by one scorer."""
    samples = Q.documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("sample_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = tiers.detections(samples, VOWEL_SCORER)
    return out.select("record_id", "sample_id", "detector_name", F.round("score", 6).alias("score"), "predicted_label", F.round(F.col("features")["vowel_share"], 6).alias("vowel_share"))


RUN = 8


def token_texts(spark, sf_dir) -> DataFrame:
    """Runs of vectors stand in for texts of as many tokens: grp, vectors, ids."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("embedding is not null")
    rows = rows.select((F.col("vec_id") / RUN).cast("long").alias("grp"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    token = F.floor(F.get("v", 0) * 40).cast("int")
    ordered = rows.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v", token.alias("id")))).alias("t"))
    return ordered.select("grp", F.transform("t", lambda x: x["v"]).alias("vectors"), F.transform("t", lambda x: x["id"]).alias("ids"))


def token_matching(spark, sf_dir):
    """Each run against the next one, weighted by the runs' token frequencies, with a baseline."""
    texts = token_texts(spark, sf_dir)
    weighted = alignment.with_idf(texts, *alignment.idf(texts, "ids"), ["grp"], "ids", "w")
    others = weighted.select((F.col("grp") - 1).alias("grp"), F.col("vectors").alias("vectors_2"), F.col("w").alias("w_2"))
    pairs = weighted.join(others, "grp")
    out = pairs.withColumn("m", alignment.matched(F.col("vectors"), F.col("vectors_2"), F.col("w"), F.col("w_2"), (0.1, 0.1, 0.1)))
    return out.select("grp", *[F.round(f"m.{c}", 5).alias(c) for c in ("precision", "recall", "f1")])


def cross_perplexity(spark, sf_dir):
    """Vectors stand in for logits over a vocabulary of eight, at eight positions; the second model's come from the reversed vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("size(embedding) >= 64")
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(v, i * 8 + 1, F.lit(8)))
    ids = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.pmod(F.floor(F.get("embedding", i * 8).cast("double") * 100), F.lit(8)).cast("int"))
    raw = signals.cross_perplexity(cut(F.col("embedding")), cut(F.reverse("embedding")), ids)
    return rows.select("vec_id", raw.alias("raw")).select("vec_id", F.round("raw", 5).alias("raw"), F.round(S.cross_score(F.col("raw")), 5).alias("score"))


# A tagger and a parser are stood in for by rules over words: a sentence's words hang on one another in a chain, or on its first word.
TAGS = ("NOUN", "VERB", "ADJ", "AUX", "DET", "ADV")
RELATIONS = ("nsubj", "advcl", "conj", "obj", "xcomp")


def parsed_documents(spark, sf_dir) -> DataFrame:
    docs = X.with_words(Q.documents(spark, sf_dir))
    of = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), F.pmod(n, F.lit(len(names))).cast("int"))
    long_ago = F.flatten(F.transform("sents", lambda s: F.transform(s, lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    docs = docs.withColumn("all_words", long_ago)
    docs = docs.withColumn("tags", F.transform("all_words", lambda x: of(TAGS, F.length(x["w"]) + F.ascii(x["w"]))))
    docs = docs.withColumn("relations", F.transform("all_words", lambda x: F.when(x["i"] == 0, "ROOT").otherwise(of(RELATIONS, F.length(x["w"])))))
    head = lambda x, k: F.when(x["i"] == 0, k).when(x["i"] % 2 == 0, k - x["i"]).otherwise(k - 1)
    return docs.withColumn("heads", F.transform("all_words", lambda x, k: head(x, k)))


def tag_features(spark, sf_dir):
    out = X.tagged(parsed_documents(spark, sf_dir), "tags", "relations", "heads")
    return out.select("doc_id", *Q.rounded(out, "disc_pos_trigram_entropy", "clause_density_mean", "style_clause_density_variance"))


def rule_sentences(spark, sf_dir):
    """Each document's sentences by rules, with the code points at which they start and end."""
    docs = Q.documents(spark, sf_dir).select("doc_id", F.posexplode(tags.sentence_pieces(F.coalesce("text", F.lit("")))).alias("nth", "sentence"))
    return sentence_rows(docs).select("doc_id", "nth", "start", "stop", F.size(T.words(F.col("sentence"))).alias("n_words"))


def sentence_rows(pieces: DataFrame) -> DataFrame:
    """Adds start and stop to (doc_id, nth, sentence); what trails a sentence as white space belongs to neither."""
    from pyspark.sql import Window as W

    size = F.length("sentence").cast("long")
    before = F.coalesce(F.sum(size).over(W.partitionBy("doc_id").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    trimmed = F.length(F.rtrim("sentence", F.lit(" \t\n\x0b\f\r"))).cast("long")
    return pieces.withColumn("start", before).withColumn("stop", F.col("start") + trimmed)


def rule_features(spark, sf_dir):
    """Sentence features with sentences by rules."""
    docs = X.sentence_shape(X.with_words(Q.documents(spark, sf_dir), rules=True))
    return docs.select("doc_id", F.size("lens").cast("long").alias("n_sentences"), *Q.rounded(docs, "sentence_length_mean", "struct_sentence_length_variance", "struct_symmetry_score"))


def full_score(spark, sf_dir):
    """The score over all fifteen features: a tagger's, a parser's and a language model's columns are stood in for by rules."""
    docs = parsed_documents(spark, sf_dir)
    docs = docs.withColumn("log_probs", F.transform("words", lambda w: -F.length(w) / 2.0))
    docs = docs.withColumn("losses", F.transform("lens", lambda n: n * 3.0)).withColumn("loss_tokens", F.transform("lens", lambda n: n))
    out = X.stat_score(docs, tag="tags", relation="relations", head="heads", losses="losses", loss_tokens="loss_tokens", log_probs="log_probs")
    return out.select("doc_id", *Q.rounded(out, "lm_perplexity_mean", "lm_burstiness", "lm_token_prob_tail_ratio", "stat_score"))


def array_sql(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


PARSED_SQL = f"""
pw as (select doc_id, k, s[i] w, i - 1 i from (select doc_id, k, s, unnest(range(1, len(s) + 1)) i from sent)),
parsed as (
  select doc_id, k, i, {array_sql(TAGS)}[(length(w) + ascii(w)) % {len(TAGS)} + 1] tag, row_number() over (partition by doc_id order by k, i) place,
    case when i = 0 then 'ROOT' else {array_sql(RELATIONS)}[length(w) % {len(RELATIONS)} + 1] end rel from pw),
tri as (
  select doc_id, g, count(*)::double c from (select doc_id, tag || ' ' || lead(tag) over a || ' ' || lead(tag, 2) over a g from parsed window a as (partition by doc_id order by place)) where g is not null group by all),
trie as (select doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) ent from tri group by 1),
clauses as (
  select doc_id, k, count(*) filter (tag in {tuple(tags.CLAUSE_TAGS)} and rel in {tuple(tags.CLAUSE_RELATIONS)}) c from parsed group by 1, 2),
density as (select doc_id, avg(c) mean, var_pop(c) variance from clauses group by 1 having count(*) >= {C.MIN_SENTENCES}),
tagged as (select d.doc_id, case when len(words) >= 6 then trie.ent end disc_pos_trigram_entropy, mean clause_density_mean, variance style_clause_density_variance
  from d left join trie using (doc_id) left join density using (doc_id))"""


def pieces_sql() -> str:
    """doc_id and the pieces of each text by the sentence rules."""
    joined = rf"regexp_replace(coalesce(text, ''), '{tags.JOINED}', '\1' || chr(1) || chr(2) || '\2', 'g')"
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    ends = f"regexp_matches(p, {quoted(tags.ENDING)}) and not regexp_matches(p, {quoted(tags.SHORT)})"
    pieces = f"regexp_extract_all({joined}, {quoted(tags.PIECE)})"
    return f"""
ruled as (
  select doc_id, list_filter(string_split(array_to_string(list_transform({pieces}, lambda p: case when {ends} then p || chr(1) || chr(2) else p end), ''), chr(1) || chr(2)), lambda s: s <> '') ss from documents)"""


def oracle_sql() -> dict[str, str]:
    base, score = Q.base_sql(), Q.score_sql()
    first = "(('0x' || substr(md5(doc_id::varchar), 1, 6))::bigint / 16777215.0::double)"
    share = f"((length(t) - length(translate(t, '{VOWELS}', ''))) / greatest(length(t), 1)::double)"
    weights = vowel_weights()
    raw = f"1 / (1 + exp(({weights['bias']}::double + {weights['share']}::double * {share} - {C.CROSS_THRESHOLD}::double) * {C.CROSS_SCALE}::double))"
    trim = r"regexp_replace(s, '[\x09-\x0D\x20]+$', '')"
    words = Q.Q.words("s")
    lm = [n for n in X.SCORED]
    norms = "[" + ", ".join(Q.norm_sql(n) for n in lm) + "]"
    return {
        "gated_detection": score + f""",
tiers as (select scored.doc_id, {first} a, stat_score b, {share} v, {raw} c from scored join d using (doc_id)),
gate as (select *, case when b is null then a else a * 0.7::double + b * 0.3::double end p from tiers),
gated as (select *, p > {C.HUMAN_MAX} and p < {C.AI_MIN} g from gate),
mixed as (select *, round(case when not g then p when b is null then (a * 0.4::double + c * 0.45::double) / 0.85::double else a * 0.4::double + b * 0.15::double + c * 0.45::double end, 6) e from gated)
select doc_id, g gated, case when g then round(c, 6) end third_score, case when g then case when c > 0.5 then 'ai_like' else 'human_like' end end third_label,
  case when g then round(v, 6) end vowel_share, e ensemble_score, {Q.label_sql('e')} classification from mixed""",
        "detector_records": f"""
with d as (select doc_id::varchar sample_id, coalesce(text, '') t from documents), v as (select sample_id, {share} v, {raw} c from d)
select 'det_' || substr(sha256(sample_id || chr(10) || 'third'), 1, 16) record_id, sample_id, 'third' detector_name, round(c, 6) score,
  case when c > 0.5 then 'ai_like' else 'human_like' end predicted_label, round(v, 6) vowel_share from v""",
        "token_matching": f"""
with t as (
  select vec_id // {RUN} grp, vec_id, list_transform(embedding, lambda x: x::double) v, floor(embedding[1]::double * 40)::int id from embeddings where embedding is not null),
n as (select count(distinct grp) n from t),
df as (select id, count(distinct grp) df from t group by 1),
w as (select grp, vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v, ln(n + 1.0::double) - ln(df + 1.0::double) w from t join df using (id), n),
cosines as (select a.grp, a.vec_id r, b.vec_id c, a.w rw, b.w cw, list_dot_product(a.v, b.v) x from w a join w b on b.grp = a.grp + 1),
p as (select grp, sum(m * cw) / sum(cw) p from (select grp, c, max(x) m, any_value(cw) cw from cosines group by 1, 2) group by 1),
r as (select grp, sum(m * rw) / sum(rw) r from (select grp, r, max(x) m, any_value(rw) rw from cosines group by 1, 2) group by 1)
select grp, round((p - 0.1) / 0.9, 5) "precision", round((r - 0.1) / 0.9, 5) recall, round((2 * p * r / (p + r) - 0.1) / 0.9, 5) f1 from p join r using (grp)""",
        "cross_perplexity": f"""
with e as (select vec_id, embedding e, list_reverse(embedding) q from embeddings where len(embedding) >= 64),
pos as (select vec_id, i, e[i * 8 + 1:i * 8 + 8] o, q[i * 8 + 1:i * 8 + 8] q, (((floor(e[i * 8 + 9]::double * 100)::bigint % 8) + 8) % 8)::int id from e, (select unnest(range(0, 7)) i)),
lse as (select *, ln(list_sum(list_transform(o, lambda x: exp(x::double)))) lo, list_sum(list_transform(q, lambda x: exp(x::double))) zq from pos),
each as (select vec_id, lo - o[id + 1]::double own, list_sum(list_transform(range(1, 9), lambda k: exp(q[k]::double) / zq * (lo - o[k]::double))) crossed from lse),
r as (select vec_id, sum(own) / sum(crossed) raw from each group by 1)
select vec_id, round(raw, 5) raw, round(1 / (1 + exp((raw - {C.CROSS_THRESHOLD}::double) * {C.CROSS_SCALE}::double)), 5) score from r""",
        "tag_features": base + "," + PARSED_SQL + f" select doc_id, {Q.r6('disc_pos_trigram_entropy', 'clause_density_mean', 'style_clause_density_variance')} from tagged",
        "rule_sentences": f"with {pieces_sql()}, " + rf"""
each as (select doc_id, unnest(range(0, len(ss))) nth, unnest(ss) s from ruled),
placed as (select *, (coalesce(sum(length(s)) over (partition by doc_id order by nth rows between unbounded preceding and 1 preceding), 0))::bigint start from each)
select doc_id, nth::int nth, start, start + length({trim}) stop, len({words})::int n_words from placed""",
        "rule_features": f"with {pieces_sql()}, " + rf"""
d as (select doc_id, list_transform(list_filter(ss, lambda s: regexp_matches(s, '[^\x09-\x0D\x20]')), lambda s: {words}) sents from ruled),
sent as (select doc_id, unnest(sents) s from d), shape as (select doc_id, count(*) n, avg(len(s)) m, var_pop(len(s)) v from sent group by 1)
select d.doc_id, len(sents) n_sentences, round(m, 6) + 0.0::double sentence_length_mean, round(v, 6) + 0.0::double struct_sentence_length_variance,
  round(case when n >= {C.MIN_SENTENCES} and m > 0 then 1 - least(1, sqrt(v) / m) end, 6) + 0.0::double struct_symmetry_score from d left join shape using (doc_id)""",
        "full_score": base + "," + PARSED_SQL + f""",
lp as (select doc_id, -length(w) / 2.0::double x from w),
q as (select doc_id, quantile_cont(x, 0.1) q, count(*) n from lp group by 1),
tail as (select doc_id, avg((x < q)::int) lm_token_prob_tail_ratio from lp join q using (doc_id) where n > 1 group by 1),
loss as (select doc_id, avg(3.0::double * len(s)) lm_perplexity_mean, stddev_pop(3.0::double * len(s)) lm_burstiness from sent where len(s) >= 10 group by 1 having count(*) >= 3),
every as (select * from feats left join (select doc_id, disc_pos_trigram_entropy, style_clause_density_variance from tagged) using (doc_id) left join tail using (doc_id) left join loss using (doc_id)),
final as (select *, case when n_spaced >= {C.MIN_WORDS} then coalesce(list_avg(list_filter({norms}, lambda x: x is not null)), 0.5) end stat_score from every)
select doc_id, {Q.r6('lm_perplexity_mean', 'lm_burstiness', 'lm_token_prob_tail_ratio', 'stat_score')} from final""",
    }


QUERIES = {f.__name__: f for f in (gated_detection, detector_records, token_matching, cross_perplexity, tag_features, rule_sentences, rule_features, full_score)}
