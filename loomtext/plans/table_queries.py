"""Queries over spans, nearest sizes, records, saved progress and the gates of rewrites, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import pairs as P
from loomtext.functions import tags
from loomtext.operators import cascade, chunks, nearest, spans
from loomtext.operators.shared import kept, new_folder
from loomtext.plans import feature_queries, pair_queries
from loomtext.plans import tier_queries as T
from loomtext.sources import progress, records

LONG_WORD = 9


def span_overlaps(spark, sf_dir):
    """Per document, how many of its long words lie in sentences, and how many of their characters."""
    docs = feature_queries.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pieces = lambda column: T.sentence_rows(docs.select("doc_id", F.posexplode(column).alias("nth", "sentence")))
    sentences = pieces(tags.sentence_pieces(F.col("text"))).select("doc_id", "start", F.col("stop").alias("end"))
    words = pieces(F.regexp_extract_all("text", F.lit(tags.PIECE), F.lit(0))).select("doc_id", "start", F.col("stop").alias("end"))
    both = spans.overlaps(words.filter(F.col("end") - F.col("start") >= LONG_WORD), sentences, "doc_id")
    shared = F.least("left.end", "right.end") - F.greatest("left.start", "right.start")
    return both.groupBy("left.doc_id").agg(F.count("*").alias("n"), F.sum(shared).alias("characters"))


def nearest_supplier(spark, sf_dir):
    """For each customer the supplier of their nation whose balance is nearest."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    asks = table("customer").select("c_custkey", F.col("c_nationkey").alias("family"), F.col("c_acctbal").cast("double").alias("size"), F.lit("-").alias("name"))
    offers = table("supplier").select(F.col("s_nationkey").alias("family"), F.col("s_acctbal").cast("double").alias("size"), F.col("s_name").alias("name"))
    out = nearest.resolved(asks, offers, positive=False)
    return out.select("c_custkey", F.col("found.name").alias("s_name"), F.round(F.abs(F.col("found.size") - F.col("size")), 2).alias("gap"), F.col("found.how").alias("how"))


def record_round_trip(spark, sf_dir):
    """Turns of conversations as records of three types, some with fields left out, written as JSON and read again."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text").cast("bigint")
    kind = F.when(F.col("role") == "system", "StructuralChunk").when(F.col("role") == "assistant", "ProseChunk").otherwise("Chunk")
    none = F.lit(None)
    start = F.when(F.col("turn") == 5, n + 1).otherwise(F.col("turn").cast("bigint"))
    record = F.struct(
        kind.alias("record_class"), F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.lit("structural").alias("chunk_type"), start.alias("start_pos"), (n + F.when(F.col("turn") == 5, 0).otherwise(F.col("turn"))).alias("end_pos"),
        F.create_map(F.lit("role"), F.col("role")).alias("metadata"), none.cast("map<string,string>").alias("math_placeholders"), none.cast("map<string,string>").alias("term_placeholders"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("~"), F.col("text"))).alias("protected_text"), none.cast("string").alias("domain_hint"), none.cast("string").alias("raw_content"),
    )
    out = records.decoded(rows.select("conv_id", "turn", records.encoded(record).alias("json")), "json", strict=False)
    r = F.col("record")
    return out.select(
        "conv_id", "turn", r["record_class"].alias("record_class"), r["chunk_type"].alias("chunk_type"), (r["end_pos"] - r["start_pos"]).alias("size"), F.md5(r["text"].cast("binary")).alias("text_digest"),
        F.md5(r["protected_text"].cast("binary")).alias("protected_digest"), F.length(r["raw_content"]).alias("raw_chars"), r["metadata"]["role"].alias("role"), F.col("record_problem").alias("problem"),
    )


def progress_upsert(spark, sf_dir):
    """Scores of documents that are saved in three batches, one of them twice, compacted, and loaded for the documents of one language."""
    docs = feature_queries.documents(spark, sf_dir).select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.col("doc_id").cast("string").alias("chunk_id"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    path = new_folder(spark, "progress")
    try:
        for batch, factor, rows in ((0, 1, docs), (0, 1, docs), (1, 2, docs.filter("size > 400")), (2, 3, docs.filter("size > 1500"))):
            progress.save(rows.select("digest", "chunk_id", (F.col("size") * factor).alias("score")), path, "scoring", batch)
        progress.compact(spark, path)
        some = docs.filter("lang = 'en'").select("digest")
        found = progress.load(spark, path, some, "scoring")
        return kept(found.select("chunk_id", F.get_json_object("result", "$.score").cast("long").alias("score")))
    finally:
        progress.clear(spark, path)


def candidates(spark, sf_dir) -> DataFrame:
    """Turns of conversations as rewrites: some echo their instructions; similarities, counts and labels come from their numbers."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    k = F.length("t").cast("long") * 7 + F.col("turn") * 3 + F.col("conv_id")
    text = F.when(k % 11 == 0, F.concat(F.col("t"), F.lit(" Please note that\nyour   instructions say more."))).otherwise(F.col("t"))
    return c.withColumn("k", k).select("conv_id", "turn", "k", text.alias("text"), (F.pmod("k", F.lit(101)) / 100.0).alias("similarity"))


def rewrite_gates(spark, sf_dir):
    """Which gate stops a rewrite, whether its original stays, and what entailment both ways is worth."""
    c, k = candidates(spark, sf_dir), F.col("k")
    labels = F.array(*[F.lit(x) for x in ("entailment", "neutral", "contradiction")])
    label = lambda n: F.get(labels, F.pmod(n, F.lit(3)).cast("int"))
    keeps = cascade.keeps_original(k % 7, k % 2, F.length("text"), k % 6, k % 5 == 0)
    return c.select(
        "conv_id", "turn", F.coalesce(cascade.gate(F.col("text"), F.col("similarity"), 0.3, 0.65), F.lit("none")).alias("gate"), keeps.alias("keeps_original"),
        P.nli_score(label(k), label(F.floor(k / 3))).alias("nli_score"),
    )


def evaluation_summary(spark, sf_dir):
    """Pass rate, scores and labels of the evaluated rewrites."""
    out = cascade.evaluation_summary(cascade.evaluated(pair_queries.rewrites(spark, sf_dir), similarity=0.1))
    labels = F.array_join(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("pass_rate", "similarity_min", "similarity_mean", "similarity_max")], labels.alias("labels"))


def group_fan_out(spark, sf_dir):
    """Turns with the number of words of the group that they were merged into."""
    groups = pair_queries.merge_short_turns(spark, sf_dir)
    rows = groups.select("conv_id", "group_no", F.split("members", ",").cast("array<int>").alias("members"))
    return chunks.fanned_out(rows, groups.select("conv_id", "group_no", "words"), "conv_id")


def oracle_sql() -> dict[str, str]:
    spaces = r"[\x09-\x0D\x20]+$"
    placed = lambda name, source: f"{name} as (select doc_id, start, start + length(regexp_replace(s, '{spaces}', '')) stop from (select doc_id, s, coalesce(sum(length(s)) over (partition by doc_id order by nth rows between unbounded preceding and 1 preceding), 0)::bigint start from (select doc_id, unnest(range(0, len(ss))) nth, unnest(ss) s from {source})))"
    return {
        "span_overlaps": f"""
with {T.pieces_sql()}, cut as (select doc_id, regexp_extract_all(coalesce(text, ''), '{tags.PIECE}') ss from documents),
{placed('sentences', 'ruled')}, {placed('words', 'cut')}
select w.doc_id, count(*) n, sum(least(w.stop, s.stop) - greatest(w.start, s.start))::bigint characters
from words w join sentences s on w.doc_id = s.doc_id and w.start < s.stop and s.start < w.stop where w.stop - w.start >= {LONG_WORD} group by 1""",
        "nearest_supplier": """
with gaps as (
  select c_custkey, s_name, c_acctbal::double a, s_acctbal::double b from customer join supplier on c_nationkey = s_nationkey),
best as (select *, row_number() over (partition by c_custkey order by abs(b - a), b, s_name) nth from gaps)
select c_custkey, s_name, round(abs(b - a), 2) gap, case when s_name is not null then 'size' end how from customer left join (select * from best where nth = 1) using (c_custkey)""",
        "record_round_trip": """
with c as (select conv_id, turn, role, coalesce(text, '') t, case role when 'system' then 'StructuralChunk' when 'assistant' then 'ProseChunk' else 'Chunk' end k, turn = 5 bad from conversations)
select conv_id, turn, case when not bad then k end record_class, case when not bad then case k when 'ProseChunk' then 'prose' else 'structural' end end chunk_type, case when not bad then length(t)::bigint end size,
  case when not bad then md5(t) end text_digest, case when not bad and k = 'ProseChunk' then md5(case when turn % 2 = 0 then '~' || t else t end) end protected_digest,
  case when not bad and k = 'StructuralChunk' then length(t)::int end raw_chars, case when not bad then role end "role",
  case when bad then 'end_pos ' || length(t) || ' lies before start_pos ' || (length(t) + 1) end problem from c""",
        "progress_upsert": """
with d as (select doc_id::varchar chunk_id, lang, sha256(coalesce(text, '')) digest, length(coalesce(text, '')) size from documents)
select chunk_id, (size * case when size > 1500 then 3 when size > 400 then 2 else 1 end)::bigint score from d where digest in (select digest from d where lang = 'en')""",
        "evaluation_summary": pair_queries.cascade_sql() + """,
labels as (select string_agg(nli_forward || '=' || n, ',' order by nli_forward) labels from (select nli_forward, count(*) n from x where nli_forward is not null group by 1))
select n, round(pass_rate, 6) pass_rate, round(lo, 6) similarity_min, round(mean, 6) similarity_mean, round(hi, 6) similarity_max, labels
from (select count(*) n, avg(passed::int) pass_rate, min(similarity) lo, avg(similarity) mean, max(similarity) hi from x), labels""",
        "group_fan_out": f"select conv_id, group_no, unnest(string_split(members, ','))::int pos, words from ({pair_queries.oracle_sql()['merge_short_turns']})",
        "rewrite_gates": """
with c as (select conv_id, turn, coalesce(text, '') t, length(coalesce(text, '')) * 7 + turn * 3 + conv_id k from conversations),
x as (select *, k % 11 = 0 echo, length(t) + case when k % 11 = 0 then length(' Please note that.your...instructions say more.') else 0 end n, ['entailment', 'neutral', 'contradiction'][k % 3 + 1] f, ['entailment', 'neutral', 'contradiction'][(k // 3) % 3 + 1] b from c)
select conv_id, turn, case when echo then 'prompt_echo' when k % 101 < 30 then 'hard_floor' when k % 101 < 65 then 'semantic_gate' else 'none' end gate,
  (k % 2 >= 1 and n <= 220) or k % 7 >= 5 or k % 6 >= 5 or (k % 5 = 0 and k % 6 > 0) keeps_original,
  case when f = 'contradiction' or b = 'contradiction' then 0.0::double when f = 'entailment' and b = 'entailment' then 1.0::double when f = 'entailment' then 0.5::double else 0.25::double end nli_score from x""",
    }


QUERIES = {f.__name__: f for f in (span_overlaps, nearest_supplier, record_round_trip, progress_upsert, rewrite_gates, evaluation_summary, group_fan_out)}
