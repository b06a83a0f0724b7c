"""Runs as tables, and reports over them.

A run has four tables with the columns doc_id and chunk_id: chunks (pos, kind, start, end, text), detections (score, label), rewrites
(original, rewritten, operator, fallback, diagnostics: map of counts) and evaluations (passed, stage, reason and scores). Results may be
repeated; `order` names the column that tells which came first. Picking one of them is a `max_by`, so partial results are merged
before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators import chunks as O

COUNTERS = ("placeholder_failures", "semantic_gate_rejections", "low_similarity_rejections", "prompt_echo_rejections", "restore_failures", "retries_used")


def one_of(rows: DataFrame, key: str, order: str, name: str, last: bool = True) -> DataFrame:
    """key and, as a struct, the last (or first) of its rows."""
    pick = F.max_by if last else F.min_by
    return rows.groupBy(key).agg(pick(F.struct(*[c for c in rows.columns if c != key]), order).alias(name))


def joined(chunks: DataFrame, detections: DataFrame, rewrites: DataFrame, evaluations: DataFrame, order: str = "seq") -> DataFrame:
    """chunks with the structs detection, rewrite and evaluation: the last result of each, null where there is none."""
    for rows, name in ((detections, "detection"), (rewrites, "rewrite"), (evaluations, "evaluation")):
        chunks = chunks.join(one_of(rows.drop("doc_id"), "chunk_id", order, name), "chunk_id", "left")
    return chunks


def targets(chunks: DataFrame, detections: DataFrame, ambiguous: bool = False, order: str = "seq") -> DataFrame:
    """Prose chunks whose last detection asks for a rewrite, with its score and label."""
    last = one_of(detections.select("chunk_id", "score", "label", order), "chunk_id", order, "d").select("chunk_id", "d.score", "d.label")
    wanted = ("ai_generated", "ambiguous") if ambiguous else ("ai_generated",)
    return chunks.filter("kind = 'prose'").join(last.filter(F.col("label").isin(*wanted)), "chunk_id")


def rejected(evaluations: DataFrame, rewrites: DataFrame, order: str = "seq") -> DataFrame:
    """Evaluations that name a stage at which a rewrite was rejected, with operator and fallback of the chunk's first rewrite."""
    first = one_of(rewrites.select("chunk_id", "operator", "fallback", order), "chunk_id", order, "r", last=False)
    return evaluations.filter("stage is not null").join(first, "chunk_id", "left").select(*evaluations.columns, "r.operator", "r.fallback")


def histogram(rows: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    """by and the map from each value, other than null, to its number."""
    counts = rows.select(by, value.alias("value")).filter("value is not null").groupBy(by, "value").agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias(name))


def failure_reason(reason: Column) -> Column:
    """Why a chunk failed, in a few classes; other reasons by their first 80 characters."""
    low = F.lower(reason)
    found = F.when(reason.rlike("[Pp]laceholder"), "placeholder preservation failed").when(F.contains(reason, F.lit("Ollama")) | low.contains("connection"), "LLM connection/generation error")
    return found.when(low.contains("timeout"), "LLM timeout").otherwise(F.substring(reason, 1, 80))


def run_summary(chunks: DataFrame, detections: DataFrame, rewrites: DataFrame, evaluations: DataFrame, failures: DataFrame | None = None, by: str = "doc_id") -> DataFrame:
    """One row per document (or other key): how many chunks were found, flagged, rewritten, passed and failed, and why.

    Ambiguous chunks count as flagged. `failures` has the columns doc_id, chunk_id and reason.
    """
    counter = lambda name: F.coalesce(F.try_element_at("diagnostics", F.lit(name)), F.lit(0))
    changed = F.col("rewritten") != F.col("original")
    counts = [
        (chunks, [F.count("*").alias("total_chunks"), F.count_if(F.col("kind") == "prose").alias("prose_chunks")]),
        (detections, [F.count_if(F.col("label").isin("ai_generated", "ambiguous")).alias("ai_detected")]),
        (rewrites, [F.count_if(changed).alias("transformed"), F.count_if(~changed).alias("unchanged"), F.count_if(counter(COUNTERS[0]) > 0).alias("chunks_with_placeholder_failures"), *[F.sum(counter(c)).alias(c) for c in COUNTERS]]),
        (evaluations, [F.count_if(F.col("passed")).alias("eval_passed"), F.count_if(~F.col("passed")).alias("eval_failed")]),
        *([(failures, [F.count_distinct("chunk_id").alias("failed")])] if failures else []),
    ]
    maps = [(rewrites, F.col("operator"), "operator_usage"), (rewrites, F.col("fallback"), "fallback_modes"), (evaluations, F.col("stage"), "rejection_stages")]
    maps += [(failures, failure_reason(F.col("reason")), "failure_reasons")] if failures else []
    out = None
    for rows, values in counts:
        part = rows.groupBy(by).agg(*values)
        out = part if out is None else out.join(part, by, "left")
    out = out.fillna(0)
    for rows, value, name in maps:
        out = out.join(histogram(rows, by, value, name), by, "left")
    return out


def rewrite_effect(rewrites: DataFrame, score: str = "score", most: float = 0.30) -> DataFrame:
    """Share of rewrites whose new score is under `most`, mean number of iterations, and how often each operator won."""
    total = rewrites.agg(F.round(F.avg((F.col(score) < most).cast("double")), 3).alias("effective"), F.round(F.avg("iterations"), 1).alias("mean_iterations"))
    used = histogram(rewrites.withColumn("all", F.lit(1)), "all", F.col("operator"), "operators").drop("all")
    return total.join(F.broadcast(used), F.lit(True), "left")  # one row each


def annotated(docs: DataFrame, chunks: DataFrame, detections: DataFrame, order: str = "seq") -> DataFrame:
    """doc_id and the text (doc_id, format, text) with a comment line before each chunk that has a detection; starts count characters."""
    last = one_of(detections.select("chunk_id", "score", "label", order), "chunk_id", order, "d")
    latex = F.col("format") == "latex"
    said = F.format_string("chunk=%s score=%.3f class=%s", F.substring("chunk_id", 1, 8), "d.score", "d.label")
    rows = chunks.select("doc_id", "chunk_id", "start").join(last, "chunk_id").select("doc_id", F.struct("start", F.col("start").alias("end"), said.alias("said")).alias("mark"))
    rows = rows.groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))
    line = lambda m: F.when(latex, F.concat(F.lit("%% "), m["said"])).otherwise(F.concat(F.lit("<!-- "), m["said"], F.lit(" -->")))
    marks = F.transform("marks", lambda m: F.struct(m["start"], m["end"], F.concat(line(m), F.lit("\n")).alias("text")))
    out = docs.join(rows, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("marks").isNull(), F.col("text")).otherwise(O.splice(F.col("text"), marks)).alias("report"))


def json_reports(docs: DataFrame, joined_chunks: DataFrame, summaries: DataFrame, profile: str = "balanced", at: str | None = None) -> DataFrame:
    """doc_id and a JSON text: what was read (path, format) and how, the summary, and each chunk with its results.

    docs has the columns doc_id, path and format, and may have output_path and compilation_valid. `at` is the time to name.
    """
    present = ("detection", "rewrite", "evaluation")
    chunk = F.struct("pos", F.col("chunk_id").alias("id"), F.col("kind").alias("type"), F.substring("text", 1, 100).alias("text_preview"), *present)
    chunks = joined_chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.to_json(chunk).alias("json")))).alias("rows"))
    summary = summaries.select("doc_id", F.to_json(F.struct(*[c for c in summaries.columns if c != "doc_id"])).alias("summary"))
    about = [F.col("path").alias("input_path"), "format", F.lit(profile).alias("profile"), (F.lit(at) if at else F.current_timestamp().cast("string")).alias("timestamp")]
    about += [F.col(c) for c in ("output_path", "compilation_valid") if c in docs.columns]
    head = docs.select("doc_id", F.to_json(F.struct(*about)).alias("head"))
    out = head.join(summary, "doc_id", "left").join(chunks, "doc_id", "left")
    body = F.concat(F.rtrim("head", F.lit("}")), F.lit(', "summary": '), F.coalesce("summary", F.lit("{}")), F.lit(', "chunks": ['), F.coalesce(F.array_join("rows.json", ", "), F.lit("")), F.lit("]}"))
    return out.select("doc_id", body.alias("report"))


def text_reports(docs: DataFrame, joined_chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """doc_id and a text with counts, then a line for each detection, evaluation and rewrite, in the order of the chunks."""
    short = F.substring("chunk_id", 1, 8)
    detection = F.format_string("  [%s] score=%.3f class=%s", short, "detection.score", "detection.label")
    reason = F.when(F.col("evaluation.reason").isNotNull(), F.concat(F.lit(" ("), F.col("evaluation.reason"), F.lit(")"))).otherwise("")
    stage = F.when(F.col("evaluation.stage").isNotNull(), F.concat(F.lit(" stage="), F.col("evaluation.stage"))).otherwise("")
    evaluation = F.concat(F.format_string("  [%s] %s", short, F.when(F.col("evaluation.passed"), "PASS").otherwise("FAIL")), stage, reason)
    counter = lambda c: F.coalesce(F.try_element_at("rewrite.diagnostics", F.lit(c)), F.lit(0))
    rewrite = F.format_string("  [%s] op=%s retries=%d placeholder_failures=%d semantic_gate_rejections=%d", short, "rewrite.operator", counter("retries_used"), counter("placeholder_failures"), counter("semantic_gate_rejections"))
    rows = joined_chunks.groupBy("doc_id").agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("pos", line.alias("line"))))), lambda x: x["line"]).alias(name) for name, line in (("detection", detection), ("evaluation", evaluation), ("rewrite", rewrite))]
    )
    facts = (("Total chunks", "total_chunks"), ("Prose chunks", "prose_chunks"), ("AI-detected", "ai_detected"), ("Transformed", "transformed"), ("Unchanged", "unchanged"), ("Eval passed", "eval_passed"), ("Eval failed", "eval_failed"))
    count = lambda title, c: F.format_string(f"  {title + ':':<17} %d", F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")))
    block = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"\n\n{title}\n{'-' * 30}\n"), F.array_join(lines, "\n"))).otherwise("")
    out = docs.join(summaries, "doc_id", "left").join(rows, "doc_id", "left")
    head = F.concat_ws("\n", F.lit("Report"), F.lit("=" * 50), F.concat(F.lit("Input:  "), F.col("path")), F.concat(F.lit("Format: "), F.col("format")), F.lit(""), F.lit("Summary"), F.lit("-" * 30), *[count(*f) for f in facts])
    return out.select("doc_id", F.concat(head, block("Detection Results", F.col("detection")), block("Evaluation Results", F.col("evaluation")), block("Transform Diagnostics", F.col("rewrite"))).alias("report"))


def report(kind: str, docs: DataFrame, chunks: DataFrame, detections: DataFrame, rewrites: DataFrame | None = None, evaluations: DataFrame | None = None, **options) -> DataFrame:
    """doc_id and the report of one kind: json and text need all tables, annotated those of chunks and detections."""
    if kind == "annotated":
        return annotated(docs, chunks, detections, **options)
    if kind not in ("json", "text"):
        raise ValueError(f"unknown kind of report: {kind!r}")
    if rewrites is None or evaluations is None:
        raise ValueError(f"{kind} reports need rewrites and evaluations")
    rows, summary = joined(chunks, detections, rewrites, evaluations), run_summary(chunks, detections, rewrites, evaluations)
    return json_reports(docs, rows, summary, **options) if kind == "json" else text_reports(docs, rows, summary)
