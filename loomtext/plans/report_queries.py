"""Queries over the tables of a run, and over a model's numbers, with their SQL. Turns of conversations stand in for chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import signals
from loomtext.functions import text as T
from loomtext.operators import documents as D
from loomtext.operators import reports as R


def run_tables(spark, sf_dir) -> tuple[DataFrame, ...]:
    """chunks, detections, rewrites, evaluations and failures; some results are repeated, others missing, by the turns' numbers."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("text is not null")
    k = F.length("text").cast("long") * 7 + F.col("turn") * 3
    c = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("pos"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.when(F.col("role") == "system", "structural").otherwise("prose").alias("kind"), "text", k.alias("k"))
    twice = c.withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("score", F.pmod(F.col("k") + F.col("seq") * 31, F.lit(100)) / 100.0)
    label = F.when(F.col("score") <= 0.3, "human").when(F.col("score") >= 0.65, "ai_generated").otherwise("ambiguous")
    detections = twice.filter("k % 4 <> 0").select("doc_id", "chunk_id", "seq", "score", label.alias("label"))
    operator = F.get(F.array(*[F.lit(x) for x in ("STANDARD", "RESTRUCTURE", "REORDER")]), F.pmod(F.col("k") + F.col("seq"), F.lit(3)).cast("int"))
    counts = F.create_map(F.lit("placeholder_failures"), F.pmod("k", F.lit(2)).cast("int"), F.lit("retries_used"), F.col("seq"))
    new = F.when(F.col("k") % 5 == 0, F.col("text")).otherwise(F.upper("text"))
    rewrites = twice.filter("k % 3 = 0").select("doc_id", "chunk_id", "seq", F.col("text").alias("original"), new.alias("rewritten"), operator.alias("operator"), F.when(F.col("k") % 7 == 0, "keep_original").alias("fallback"), counts.alias("diagnostics"), "score", (F.col("seq") + 1 + F.pmod("k", F.lit(3))).alias("iterations"))
    stage = F.when(F.col("k") % 6 == 0, "nli").when(F.col("k") % 6 == 3, "similarity")
    evaluations = c.filter("k % 3 <> 1").select("doc_id", "chunk_id", F.lit(0).alias("seq"), stage.isNull().alias("passed"), stage.alias("stage"), F.concat(stage, F.lit(" failed")).alias("reason"))
    reason = F.when(F.col("k") % 11 == 0, "Placeholder lost").when(F.col("k") % 11 == 1, "Connection refused").otherwise("read timeout")
    return c, detections, rewrites, evaluations, c.filter("k % 11 < 3").select("doc_id", "chunk_id", reason.alias("reason"))


TABLES_SQL = """
with c as (
  select conv_id doc_id, turn::int pos, conv_id || '-' || turn chunk_id, case when role = 'system' then 'structural' else 'prose' end kind, text,
    length(text) * 7 + turn * 3 k from conversations where text is not null),
twice as (select *, ((k + seq * 31) % 100) / 100.0 score from c, (select unnest([0, 1]) seq)),
detections as (
  select doc_id, chunk_id, seq, score::double score, case when score <= 0.3 then 'human' when score >= 0.65 then 'ai_generated' else 'ambiguous' end label
  from twice where k % 4 <> 0),
rewrites as (
  select doc_id, chunk_id, seq, text original, case when k % 5 = 0 then text else upper(text) end rewritten, ['STANDARD', 'RESTRUCTURE', 'REORDER'][((k + seq) % 3)::int + 1] operator,
    case when k % 7 = 0 then 'keep_original' end fallback, k % 2 placeholder_failures, seq retries_used, score::double score, seq + 1 + k % 3 iterations
  from twice where k % 3 = 0),
evaluations as (select *, stage is null passed, stage || ' failed' reason from (select doc_id, chunk_id, case k % 6 when 0 then 'nli' when 3 then 'similarity' end stage from c where k % 3 <> 1)),
failures as (select doc_id, chunk_id, case k % 11 when 0 then 'placeholder preservation failed' when 1 then 'LLM connection/generation error' else 'LLM timeout' end reason from c where k % 11 < 3),
last_d as (select chunk_id, arg_max(score, seq) score, arg_max(label, seq) label from detections group by 1)
"""


def report_join(spark, sf_dir):
    chunks, detections, rewrites, evaluations, _ = run_tables(spark, sf_dir)
    out = R.joined(chunks, detections, rewrites, evaluations)
    return out.select("doc_id", "pos", F.substring("text", 1, 100).alias("preview"), F.round("detection.score", 2).alias("score"), "detection.label", "rewrite.operator", "evaluation.passed", "evaluation.stage")


def rewrite_targets(spark, sf_dir):
    chunks, detections, *_ = run_tables(spark, sf_dir)
    return R.targets(chunks, detections, ambiguous=True).select("doc_id", "pos", F.round("score", 2).alias("score"), "label")


def rejected_rewrites(spark, sf_dir):
    _, _, rewrites, evaluations, _ = run_tables(spark, sf_dir)
    return R.rejected(evaluations, rewrites).select("doc_id", "chunk_id", "stage", "reason", "operator", "fallback")


def flat(column: str):
    """A map as text, by its keys."""
    return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(column)


def run_summary(spark, sf_dir):
    out = R.run_summary(*run_tables(spark, sf_dir))
    return out.select(*[F.col(c).cast("long").alias(c) if not t.startswith("map") and c != "doc_id" else flat(c) if c != "doc_id" else F.col(c) for c, t in out.dtypes])


def rewrite_effect(spark, sf_dir):
    _, _, rewrites, _, _ = run_tables(spark, sf_dir)
    return R.rewrite_effect(rewrites).withColumn("operators", flat("operators"))


def numbers(spark, sf_dir) -> DataFrame:
    """Components of embeddings stand in for a model's log-probabilities."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("embedding is not null")
    return rows.select("vec_id", F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("v"))


def token_distribution(spark, sf_dir):
    out = numbers(spark, sf_dir).select("vec_id", signals.token_distribution(F.col("v")).alias("d"))
    return out.select("vec_id", *[F.round(f"d.{c}", 4).alias(c) for c in ("mean_log_prob", "std_log_prob", "skewness", "kurtosis", "tail_ratio")])


def sentence_losses(spark, sf_dir):
    rows = numbers(spark, sf_dir)
    tokens = F.transform("v", lambda x, i: F.pmod(i + F.col("vec_id").cast("int"), F.lit(20)))
    out = rows.select("vec_id", signals.sentence_losses(F.col("v"), tokens).alias("d"))
    return out.select("vec_id", *[F.round(f"d.{c}", 5).alias(c) for c in ("mean", "std", "min", "max")])


def annotated(spark, sf_dir):
    """Conversations as documents, a comment line before each turn that has a detection."""
    chunks, detections, *_ = run_tables(spark, sf_dir)
    turns = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "chunk_id"))).alias("turns"))
    texts = F.transform("turns", lambda t: F.concat(t["text"], F.lit("\n")))
    docs = turns.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "latex").otherwise("markdown").alias("format"), F.array_join(texts, "").alias("text"), "turns", F.transform(texts, F.length).alias("sizes"))
    placed = docs.select("doc_id", F.posexplode(F.arrays_zip(F.transform("turns", lambda t: t["chunk_id"]).alias("id"), T.sums_before(F.col("sizes")).alias("start"))).alias("k", "c"))
    starts = placed.select("doc_id", F.col("c.id").alias("chunk_id"), F.col("c.start").cast("int").alias("start"))
    return R.annotated(docs.select("doc_id", "format", "text"), starts, detections).select("doc_id", F.md5(F.col("report").cast("binary")).alias("digest"))


def markdown_errors(spark, sf_dir):
    """Documents with formulas, code and escaped dollar signs between their lines."""
    marks = F.array(*[F.lit(x) for x in ("\n", "\n$", " \\$ ", " `a$b` ", "\n```\n$\n```\n", " $x$ ")])
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    lines = F.transform(F.split("t", "\n"), lambda x, i: F.concat(x, F.get(marks, F.pmod(i + F.col("doc_id").cast("int"), F.lit(6)))))
    return d.select("doc_id", D.markdown_error(F.array_join(lines, "")).alias("error"))


def oracle_sql() -> dict[str, str]:
    hist = lambda rows, value: f"(select doc_id, string_agg(v || '=' || n, ',' order by v) m from (select doc_id, {value} v, count(*) n from {rows} where {value} is not null group by 1, 2) group by 1)"
    counters = ", ".join(f"sum({c})::bigint {c}" if c in ("placeholder_failures", "retries_used") else f"0::bigint {c}" for c in R.COUNTERS)
    zero = lambda *names: ", ".join(f"coalesce({n}, 0)::bigint {n}" for n in names)
    v = "v as (select vec_id, list_transform(embedding, lambda x: -abs(x::double)) v from embeddings where embedding is not null)"
    return {
        "report_join": TABLES_SQL + """, last_r as (select chunk_id, arg_max(operator, seq) operator from rewrites group by 1)
select doc_id, pos, substr(text, 1, 100) preview, round(score, 2) score, label, operator, passed, stage
from c left join last_d using (chunk_id) left join last_r using (chunk_id) left join (select chunk_id, passed, stage from evaluations) using (chunk_id)""",
        "rewrite_targets": TABLES_SQL + "select doc_id, pos, round(score, 2) score, label from c join last_d using (chunk_id) where kind = 'prose' and label in ('ai_generated', 'ambiguous')",
        "rejected_rewrites": TABLES_SQL + """
select doc_id, chunk_id, stage, reason, operator, fallback from evaluations
left join (select chunk_id, operator, fallback from rewrites where seq = 0) using (chunk_id) where stage is not null""",
        "run_summary": TABLES_SQL + f"""
select doc_id, total_chunks, prose_chunks, {zero('ai_detected', 'transformed', 'unchanged', 'chunks_with_placeholder_failures', *R.COUNTERS, 'eval_passed', 'eval_failed', 'failed')},
  o.m operator_usage, f.m fallback_modes, s.m rejection_stages, r.m failure_reasons
from (select doc_id, count(*) total_chunks, count(*) filter (kind = 'prose') prose_chunks from c group by 1)
left join (select doc_id, count(*) filter (label in ('ai_generated', 'ambiguous')) ai_detected from detections group by 1) using (doc_id)
left join (select doc_id, count(*) filter (rewritten <> original) transformed, count(*) filter (rewritten = original) unchanged,
  count(*) filter (placeholder_failures > 0) chunks_with_placeholder_failures, {counters} from rewrites group by 1) using (doc_id)
left join (select doc_id, count(*) filter (passed) eval_passed, count(*) filter (not passed) eval_failed from evaluations group by 1) using (doc_id)
left join (select doc_id, count(*) failed from failures group by 1) using (doc_id)
left join {hist('rewrites', 'operator')} o using (doc_id) left join {hist('rewrites', 'fallback')} f using (doc_id)
left join {hist('evaluations', 'stage')} s using (doc_id) left join {hist('failures', 'reason')} r using (doc_id)""",
        "rewrite_effect": TABLES_SQL + """
select round(avg((score < 0.3)::int), 3) effective, round(avg(iterations), 1) mean_iterations,
  (select string_agg(operator || '=' || n, ',' order by operator) from (select operator, count(*) n from rewrites group by 1)) operators from rewrites""",
        "annotated": TABLES_SQL + """
select doc_id, md5(string_agg(case when label is not null then case when doc_id % 2 = 0 then '%% ' else '<!-- ' end || 'chunk=' || substr(chunk_id, 1, 8) || ' score=' || printf('%.3f', score) || ' class=' || label
  || case when doc_id % 2 = 0 then '' else ' -->' end || chr(10) else '' end || text || chr(10), '' order by pos, text)) digest from c left join last_d using (chunk_id) group by 1""",
        "token_distribution": f"""
with {v}, x as (select vec_id, unnest(v) x from v), m as (select vec_id, avg(x) m, stddev_pop(x) s, quantile_cont(x, 0.1) q, count(*) n from x group by 1)
select vec_id, round(any_value(m), 4) mean_log_prob, round(any_value(s), 4) std_log_prob, round(case when any_value(s) > 0 then avg(pow(x - m, 3)) / pow(any_value(s), 3) else 0 end, 4) skewness,
  round(case when any_value(s) > 0 then avg(pow(x - m, 4)) / pow(any_value(s), 4) - 3 else 0 end, 4) kurtosis, round(avg((x < q)::int), 4) tail_ratio
from x join m using (vec_id) where n > 1 group by 1""",
        "sentence_losses": f"""
with {v}, x as (select vec_id, unnest(v) x, unnest(range(0, len(v))) i from v),
kept as (select vec_id, x from x where (i + vec_id) % 20 >= 10), g as (select vec_id, avg(x) mean, stddev_pop(x) std, min(x) min, max(x) max from kept group by 1 having count(*) >= 3)
select vec_id, round(mean, 5) mean, round(std, 5) std, round(min, 5) min, round(max, 5) max from v left join g using (vec_id)""",
        "markdown_errors": r"""
with lines as (select doc_id, unnest(string_split(t, chr(10))) x, unnest(range(0, len(string_split(t, chr(10))))) i from (select doc_id, coalesce(text, '') t from documents)),
marked as (
  select doc_id, string_agg(x || [chr(10), chr(10) || '$', ' \$ ', ' `a$b` ', chr(10) || '```' || chr(10) || '$' || chr(10) || '```' || chr(10), ' $x$ '][((i + doc_id) % 6)::int + 1], '' order by i) t
  from lines group by 1),
plain as (select doc_id, regexp_replace(regexp_replace(t, '```[\s\S]*?```', '', 'g'), '`[^`]+`', '', 'g') t from marked),
counted as (select doc_id, length(t) - length(replace(t, '$', '')) - (length(t) - length(replace(t, '\$', ''))) // 2 n from plain)
select doc_id, case when n % 2 <> 0 then 'Unbalanced $ delimiters: ' || n || ' found (odd count)' end error from counted""",
    }


QUERIES = {f.__name__: f for f in (annotated, report_join, rewrite_targets, rejected_rewrites, run_summary, rewrite_effect, token_distribution, sentence_losses, markdown_errors)}
