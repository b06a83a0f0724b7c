"""Readers and writers: documents by folder, samples and records as JSON lines, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Formats by file ending.
FORMATS = {"tex": "latex", "latex": "latex", "ltx": "latex", "md": "markdown", "markdown": "markdown", "txt": "plaintext", "text": "plaintext"}
SAMPLE = "sample_id string, split string, domain string, source_class string, source_model string, document_format string, text string, metadata map<string,string>"
DETECTION = (
    "record_id string, sample_id string, transform_id string, detector_name string, score double, confidence double, threshold double, predicted_label string, "
    "features map<string,double>, evidence map<string,string>"
)
ALLOWED = {
    "split": ("train", "val", "test"), "source_class": ("human", "ai_raw", "ai_edited_light", "ai_edited_heavy"),
    "document_format": ("latex", "markdown", "plaintext"), "predicted_label": ("human", "ambiguous", "ai_generated"),
}


def format_of(path: Column) -> Column:
    """The format by a path's ending, whatever its case; null for others."""
    names = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.try_element_at(names, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def required_format(path: Column) -> Column:
    """The same, with an error for other endings."""
    found = format_of(path)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no format for "), path)))


def some(rows: DataFrame, path: str, what: str) -> DataFrame:
    """The rows, or an error if there are none: a path that holds nothing is most likely a wrong one."""
    if rows.isEmpty():
        raise ValueError(f"no {what} below {path}")
    return rows


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, format, text and content hash of every document below a folder; none at all is an error."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    out = files.withColumn("format", format_of(F.col("path"))).filter("format is not null")
    return some(out, path, "documents").withColumn("digest", F.sha2("text", 256))


def checked(df: DataFrame) -> DataFrame:
    """The rows, with an error for values outside ALLOWED or scores outside [0, 1]."""
    for name, values in ALLOWED.items():
        if name in df.columns:
            good = F.col(name).isin(*values)
            df = df.withColumn(name, F.when(F.coalesce(good, F.lit(False)), F.col(name)).otherwise(F.raise_error(F.concat(F.lit(f"bad {name}: "), F.coalesce(F.col(name), F.lit("null"))))))
    if "score" in df.columns:
        df = df.withColumn("score", F.when(F.col("score").between(0, 1), F.col("score")).otherwise(F.raise_error(F.concat(F.lit("bad score: "), F.col("score").cast("string")))))
    return df


def numbered_lines(spark: SparkSession, path: str, bad) -> DataFrame:
    """path, line (from 1) and value of the lines of text files for which `bad`, a function of their column, holds.

    A file is read in splits. Each split's lines are counted, so a line's number is its place in its split after those of the splits before.
    """
    base = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = base.groupBy("path", "block").agg(F.count("*").alias("lines"), F.min("at").alias("first"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select(F.col("path").alias("_path"), F.col("block").alias("_block"), "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
    found = base.filter(bad(F.col("value"))).join(splits, (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")))
    return found.select("path", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def value_problem(row: Column, names: list[str]) -> Column:
    """Why a record breaks the rules of `checked`, or null."""
    why = F.lit(None).cast("string")
    for name, values in ALLOWED.items():
        if name in names:
            v = row[name]
            why = F.coalesce(why, F.when(~F.coalesce(v.isin(*values), F.lit(False)), F.concat(F.lit(f"bad {name}: "), F.coalesce(v, F.lit("null")))))
    if "score" in names:
        v = row["score"]
        why = F.coalesce(why, F.when(~F.coalesce(v.between(0, 1), F.lit(False)), F.concat(F.lit("bad score: "), F.coalesce(v.cast("string"), F.lit("null")))))
    return why


def line_problem(value: Column, schema: str) -> Column:
    """Why a line is no record of the schema, or null; blank lines are fine."""
    names = T._parse_datatype_string(schema).names
    row = F.from_json(value, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return F.when(value.rlike(r"\S"), F.when(row.isNull() | row["_bad"].isNotNull(), F.lit("invalid JSON or type")).otherwise(value_problem(row, names)))


def jsonl_errors(spark: SparkSession, path: str, schema: str = SAMPLE) -> DataFrame:
    """path, line, reason and value of each line that is no record."""
    found = numbered_lines(spark, path, lambda v: line_problem(v, schema).isNotNull())
    return found.select("path", "line", line_problem(F.col("value"), schema).alias("reason"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: str = SAMPLE) -> DataFrame:
    """Records as JSON lines; a bad line or value is an error, blank lines are skipped. `jsonl_errors` names the bad lines."""
    return checked(spark.read.schema(schema).option("mode", "FAILFAST").json(path))


def verified_jsonl(spark: SparkSession, path: str, schema: str = SAMPLE, shown: int = 5) -> DataFrame:
    """The same, read twice: bad lines are looked for first, and the error names the first ones of them by file and line."""
    some = jsonl_errors(spark, path, schema).orderBy("path", "line").limit(shown).collect()
    if some:
        raise ValueError("; ".join(f"{r.path} line {r.line}: {r.reason}" for r in some))
    return read_jsonl(spark, path, schema)


def read_corpus(spark: SparkSession, path: str, split: str = "test", document_format: str = "plaintext") -> DataFrame:
    """Samples from domain/source_class/*.txt, named by their paths; none at all is an error."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    rows = files.select(F.sha2(F.col("_metadata.file_path"), 256).alias("sample_id"), F.lit(split).alias("split"), F.element_at(parts, -3).alias("domain"), F.element_at(parts, -2).alias("source_class"), F.lit(document_format).alias("document_format"), F.col("value").alias("text"))
    return checked(some(rows, path, "texts"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


@F.udf
def four_digits(x):
    """Rounded from what the double is exactly, ties to even. Java, and so format_string, rounds its shortest decimal, and ties up."""
    return None if x is None else f"{x:.4f}"


def metrics_rows(metrics: DataFrame) -> DataFrame:
    """Metrics with four digits, empty where undefined."""
    return metrics.select(*[four_digits(F.col(c).cast("double")).alias(c) if t in ("double", "float") else F.col(c) for c, t in metrics.dtypes])


# The columns of a metrics file, in order.
METRIC_COLUMNS = ("dimension", "value", "n_samples", "auroc", "auprc", "tpr_at_fpr5", "human_fpr", "mean_score_human", "mean_score_ai", "calibration_error")


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    """A CSV file of METRIC_COLUMNS, sorted: one row per slice, so it is small."""
    rows = metrics_rows(metrics.select(*METRIC_COLUMNS)).orderBy(F.col("dimension") != "overall", "dimension", "value")
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def text_report(chunks: DataFrame) -> DataFrame:
    """One text per document from chunks (doc_id, pos, chunk_id, score, label, text): counts, then a line per chunk in order."""
    line = F.format_string("  [%s] %s score=%.3f %s", F.substring("chunk_id", 1, 8), F.coalesce("label", F.lit("-")), F.coalesce("score", F.lit(0.0)), F.substring("text", 1, 100))
    g = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "ai_generated").alias("ai"), F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("rows"))
    head = F.format_string("Document %s: %d chunks, %d flagged", F.col("doc_id").cast("string"), "n", "ai")
    return g.select("doc_id", F.concat_ws("\n", head, F.array_join(F.col("rows.line"), "\n")).alias("report"))


def json_report(chunks: DataFrame) -> DataFrame:
    """The same as JSON."""
    row = F.struct("pos", "chunk_id", "label", "score", F.substring("text", 1, 100).alias("preview"))
    g = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("chunks"))
    return g.select("doc_id", F.to_json(F.struct("doc_id", F.size("chunks").alias("n_chunks"), "chunks")).alias("report"))


def summary_markdown(metrics: DataFrame) -> str:
    """Tables of slice metrics, overall first. Metrics have one row per slice, so they fit the driver."""
    rows = metrics_rows(metrics).orderBy("dimension", "value").collect()
    names = [c for c in metrics.columns if c not in ("dimension", "value")]
    out = []
    for dim in sorted({r.dimension for r in rows}, key=lambda d: (d != "overall", d)):
        out += [f"## {dim}", "| value | " + " | ".join(names) + " |", "|---" * (len(names) + 1) + "|"]
        out += ["| " + " | ".join([r.value, *("" if r[n] is None else str(r[n]) for n in names)]) + " |" for r in rows if r.dimension == dim] + [""]
    return "\n".join(out)


def latest(spark: SparkSession, folder: str, pattern: str = "*.json") -> str:
    """The path of the newest file of a folder: names start with their dates, so the last one in order. Nothing but names is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    newest = found.agg(F.max_by("path", F.element_at(F.split("path", "/"), -1))).first()[0]
    if newest is None:
        raise ValueError(f"no {pattern} in {folder}")
    return newest


def write_results(detections: DataFrame, metrics: DataFrame, folder: str) -> None:
    """What an experiment leaves: detections as JSON lines, metrics as CSV, and their tables in Markdown."""
    write_jsonl(detections, f"{folder}/detections.jsonl")
    write_metrics_csv(metrics, f"{folder}/metrics.csv")
    summary = summary_markdown(metrics.select(*METRIC_COLUMNS))
    metrics.sparkSession.createDataFrame([(summary,)], "text string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary.md")
