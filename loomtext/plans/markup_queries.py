"""Queries over marked-up documents, placeholders and reports. Those that need a scan with state have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import chunks as O
from loomtext.operators import markup, protect
from loomtext.plans import sql as Q
from loomtext.sources import files
from loomtext.streaming import scoring as stream


def marked(spark, sf_dir, template: str) -> DataFrame:
    """Each document's text inside a template."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, after = template.split("@")
    return d.select("doc_id", F.concat(F.lit(before), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")), F.lit(after)).alias("text"))


def markdown_chunks(spark, sf_dir):
    docs = marked(spark, sf_dir, "# Title\n\n- one\n- two\n\n```\ncode\n```\n\nWith $x + 1$ here.\n\n@\n\n| a | b |\n|---|---|\n| 1 | 2 |\n")
    out = markup.chunked(docs, markup.markdown_chunks, "doc_id")
    return out.select("doc_id", "pos", "kind", "start", "end", F.md5(F.col("text").cast("binary")).alias("digest"), F.size("math").alias("n_math"))


def latex_chunks(spark, sf_dir):
    docs = marked(spark, sf_dir, "\\documentclass{article}\n\\begin{document}\n\\section{Head}\nText with $x$ and \\emph{more}.\n\n@\n\\begin{equation}y\\end{equation}\n\\end{document}\n")
    out = markup.chunked(docs, markup.latex_chunks, "doc_id")
    return out.select("doc_id", "pos", "kind", "start", "end", F.md5(F.col("text").cast("binary")).alias("digest"))


def protect_terms(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("In (Miller, 2020) New York Times saw 42% of 7 cases. "), F.coalesce("text", F.lit(""))).alias("text"))
    p = d.withColumn("p", protect.protect(F.col("text")))
    back = protect.restored(F.col("p.text"), F.col("p.terms"), strict=False)
    return p.select("doc_id", F.size("p.terms").alias("n_terms"), (back == F.col("text")).alias("identical"), F.size(protect.lost(F.col("p.terms"), F.col("p.text"))).alias("n_lost"))


def stream_scores(spark, sf_dir):
    """The stream's transformation on a table."""
    return stream.scored(spark.read.parquet(f"{sf_dir}/documents.parquet")).groupBy("classification").agg(F.count("*").alias("n"))


def numbered_lines(spark, sf_dir):
    """A comment line before each second paragraph of each document, by line numbers."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("t", F.coalesce("text", F.lit("")))
    d = d.withColumn("n", F.size(F.split("t", "\n")))
    marks = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i % 2 == 0)
    d = d.withColumn("marks", F.transform(marks, lambda i: F.struct(i.alias("start"), i.alias("end"), F.format_string("<!-- line %d -->", i).alias("text"))))
    return d.select("doc_id", F.md5(O.splice_lines(F.col("t"), F.col("marks")).cast("binary")).alias("digest"))


def document_formats(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("/x/doc"), F.col("doc_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".TEX", ".md", ".txt", ".pdf", ".markdown")]), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))).alias("path"))
    return p.groupBy(F.coalesce(files.format_of(F.col("path")), F.lit("none")).alias("format")).agg(F.count("*").alias("n"))


def placeholder_restore(spark, sf_dir):
    """Terms that a rewrite spelled out, in its own way: repair finds their places, and they are put back as they were."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.size(T.spaced(F.coalesce("text", F.lit("")))).cast("string").alias("n"))
    terms = F.create_map(F.lit("[TERM_001]"), F.col("n"), F.lit("[TERM_002]"), F.concat(F.lit("id "), F.col("doc_id").cast("string")))
    t = protect.repaired(F.concat(F.lit("a "), F.col("n"), F.lit(" b ID -"), F.col("doc_id").cast("string"), F.lit(" c")), terms)
    return d.select("doc_id", protect.restored(t, terms).alias("restored"))


def metrics_report(spark, sf_dir):
    """Slice metrics as the report writes them."""
    from loomtext.plans.evaluation_queries import slice_metrics

    return files.metrics_rows(slice_metrics(spark, sf_dir).select("dimension", "value", "n_samples", "human_fpr", "mean_score_human"))


def oracle_sql() -> dict[str, str]:
    from loomtext.plans import evaluation_queries, feature_queries

    return {
        "stream_scores": feature_queries.score_sql() + f" select {feature_queries.label_sql('round(stat_score, 6)')} classification, count(*) n from scored group by 1",
        "numbered_lines": """
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) x, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) i from documents)
select doc_id, md5(string_agg(case when i % 2 = 0 then '<!-- line ' || i || ' -->' || chr(10) || x else x end, chr(10) order by i)) digest from l group by 1""",
        "document_formats": "select case doc_id % 5 when 0 then 'latex' when 2 then 'plaintext' when 3 then 'none' else 'markdown' end format, count(*) n from documents group by 1",
        "placeholder_restore": f"select doc_id, 'a ' || len({Q.spaced()}) || ' b id ' || doc_id || ' c' restored from documents",
        "metrics_report": evaluation_queries.cut_sql("lang", "toxic") + " select dimension, value, n_samples, printf('%.4f', round(human_fpr, 6)) human_fpr, printf('%.4f', round(mean_score_human, 6)) mean_score_human from basic",
    }


QUERIES = {f.__name__: f for f in (markdown_chunks, latex_chunks, protect_terms, stream_scores, numbered_lines, document_formats, placeholder_restore, metrics_report)}
