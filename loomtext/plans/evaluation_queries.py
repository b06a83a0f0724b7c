"""Queries that hold scores against labels, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import constants as C
from loomtext.functions import features as X
from loomtext.functions import scoring as S
from loomtext.operators import slices as O
from loomtext.plans import sql as Q

POINTS = [(0.0, 0.05), (0.3, 0.2), (0.6, 0.55), (0.9, 0.95)]
THRESHOLDS = (0.3, 0.5, 0.65, 0.8)


def rounded(value: Column, digits: int) -> Column:
    """As the SQL rounds: the scaled double, halves away from zero. Spark's round takes the shortest decimal of the double, and differs at ties."""
    scale = 10.0**digits
    return F.round(value * scale) / scale


def labelled(spark, sf_dir) -> DataFrame:
    """Documents with labels: y is 1 for low quality, the score is the normalized lexical diversity with two digits, so that scores tie."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("y"), "toxic")
    rows = X.lexical(X.with_words(docs.join(labels, "doc_id")))
    score = rounded(F.coalesce(X.normalized("style_ttr", F.col("style_ttr")), F.lit(0.5)), 2)
    return rows.select("doc_id", "lang", "source", "toxic", "y", score.alias("score"))


def slice_metrics(spark, sf_dir):
    out = O.slice_metrics(labelled(spark, sf_dir), ["lang", "toxic"])
    names = ("auroc", "auprc", "tpr_at_fpr5", "human_fpr", "mean_score_human", "mean_score_ai", "calibration_error")
    return out.select("dimension", "value", "n_samples", *[rounded(F.col(n), 6).alias(n) for n in names])


def auroc_by_lang(spark, sf_dir):
    cut = O.sliced(labelled(spark, sf_dir), ["lang"]).filter("dimension = 'lang'")
    return O.ranking(O.curve(cut)).select(F.col("value").alias("lang"), F.round("auroc", 6).alias("auroc"))


def ap_by_lang(spark, sf_dir):
    cut = O.sliced(labelled(spark, sf_dir), ["lang"]).filter("dimension = 'lang'")
    return O.ranking(O.curve(cut)).select(F.col("value").alias("lang"), F.round("auprc", 6).alias("auprc"))


def tpr_at_fpr5(spark, sf_dir):
    return O.ranking(O.curve(O.sliced(labelled(spark, sf_dir), ["lang"]))).select("dimension", "value", F.round("tpr_at_fpr5", 6).alias("tpr_at_fpr5"))


def calibration_error(spark, sf_dir):
    return O.calibration_error(O.sliced(labelled(spark, sf_dir), ["source"])).select("dimension", "value", F.round("calibration_error", 6).alias("calibration_error"))


def human_fpr(spark, sf_dir):
    return O.basics(O.sliced(labelled(spark, sf_dir), ["lang"])).select("dimension", "value", F.round("human_fpr", 6).alias("human_fpr"))


def threshold_table(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])))
    hit = (F.col("score") >= F.col("threshold")).cast("double")
    return rows.groupBy("threshold").agg(F.round(F.avg(F.when(F.col("y") == 1, hit)), 6).alias("tpr"), F.round(F.avg(F.when(F.col("y") == 0, hit)), 6).alias("fpr"))


def temperature_fit(spark, sf_dir):
    return O.fit_temperature(labelled(spark, sf_dir)).select(F.round("temperature", 6).alias("temperature"), F.round("loss", 4).alias("loss"))


def calibrated_scores(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    fitted = O.fit_temperature(rows).select("temperature")
    return rows.join(F.broadcast(fitted)).select("doc_id", "score", F.round(S.temperature_scaled(F.col("score"), F.col("temperature")), 6).alias("confidence"))  # fitted: one row


def isotonic_interp(spark, sf_dir):
    return labelled(spark, sf_dir).select("doc_id", F.round(S.interpolated(F.col("score"), POINTS), 6).alias("calibrated"))


def intensity_bucket(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(O.intensity_bucket(F.col("value") / 500.0).alias("bucket")).agg(F.count("*").alias("n"))


def detector_grid(spark, sf_dir):
    """Placeholder records of an experiment: each document once per detector."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    names = F.explode(F.array(*[F.lit(d) for d in ("classifier", "statistical")])).alias("detector")
    return docs.select("doc_id", names, F.lit(0.5).alias("score"), F.lit("ambiguous").alias("predicted_label"))


def score_summary(spark, sf_dir):
    """Counts per class, with machine-written texts counted with and without the ambiguous ones."""
    rows = labelled(spark, sf_dir).withColumn("c", S.label(F.col("score")))
    is_ = lambda *k: F.count_if(F.col("c").isin(*k))
    return rows.groupBy("lang").agg(
        F.count("*").alias("total"), is_("human").alias("human"), is_("ambiguous").alias("ambiguous"), is_("ai_generated").alias("ai_only"),
        is_("ai_generated", "ambiguous").alias("ai_or_ambiguous"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"),
    )


def rows_sql() -> str:
    low, high, _ = C.BOUNDS["style_ttr"]
    return f"""
with docs as (select doc_id, lang, source, {Q.words()} words from documents),
rows_ as (
  select doc_id, lang, source, toxic, 1 - quality y,
    round(coalesce(case when len(words) > 0 then 1 - greatest(0.0::double, least(1.0::double, (len(list_distinct(words))::double / len(words) - {low}::double) / ({high}::double - {low}::double))) end, 0.5::double), 2) score
  from docs join labels using (doc_id))"""


def cut_sql(*dimensions: str, overall: bool = True) -> str:
    parts = ["select 'overall' dimension, 'all' value, y, score from rows_"] if overall else []
    parts += [f"select '{d}', {d}::varchar, y, score from rows_ where {d} is not null" if parts or i else f"select '{d}' dimension, {d}::varchar value, y, score from rows_ where {d} is not null" for i, d in enumerate(dimensions)]
    return rows_sql() + f""",
cut as ({' union all '.join(parts)}),
pts as (select dimension, value, score, sum(y)::double pos, sum(1 - y)::double neg from cut group by all),
cum as (select *, sum(pos) over down tp, sum(neg) over down fp, sum(pos) over (partition by dimension, value) p, sum(neg) over (partition by dimension, value) n from pts
  window down as (partition by dimension, value order by score desc rows unbounded preceding)),
roc as (select *, case when p > 0 then tp / p end tpr, case when n > 0 then fp / n end fpr, coalesce(lag(tp) over (partition by dimension, value order by score desc), 0) tp0 from cum),
low as (select dimension, value, max(fpr) x0 from roc where fpr <= {O.TARGET_FPR} group by all),
low2 as (select l.dimension, l.value, l.x0, max(tpr) y0 from low l join roc r on l.dimension = r.dimension and l.value = r.value and r.fpr = l.x0 group by all),
high as (select dimension, value, min(fpr) x1 from roc where fpr > {O.TARGET_FPR} group by all),
high2 as (select h.dimension, h.value, h.x1, min(tpr) y1 from high h join roc r on h.dimension = r.dimension and h.value = r.value and r.fpr = h.x1 group by all),
area as (
  select dimension, value, max(p) > 0 and max(n) > 0 ok, sum(neg * (tp - pos / 2)) / nullif(max(p * n), 0) auroc, sum((tp - tp0) / nullif(p, 0) * tp / (tp + fp)) auprc from roc group by all),
ranked as (
  select a.dimension, a.value, case when ok then auroc end auroc, case when ok then auprc end auprc,
    case when ok then case when coalesce(x0, 0) = {O.TARGET_FPR} or x1 is null then coalesce(y0, 0)
      else coalesce(y0, 0) + ({O.TARGET_FPR}::double - coalesce(x0, 0)) * (y1 - coalesce(y0, 0)) / (x1 - coalesce(x0, 0)) end end tpr_at_fpr5
  from area a left join low2 l on a.dimension = l.dimension and a.value = l.value left join high2 h on a.dimension = h.dimension and a.value = h.value),
edges as (select i, i * 0.1::double lo, case when i = {O.BINS - 1} then 1.0000001 else (i + 1) * 0.1::double end hi from range(0, {O.BINS}) t(i)),
bins as (select dimension, value, i, count(*) k, avg(y) acc, avg(score) conf from cut join edges on score >= lo and score < hi group by all),
ece as (select dimension, value, sum(k * abs(acc - conf)) / sum(k) calibration_error from bins group by all),
basic as (
  select dimension, value, count(*) n_samples, avg(case when y = 0 then (score > 0.5)::int end) human_fpr,
    avg(case when y = 0 then score end) mean_score_human, avg(case when y = 1 then score end) mean_score_ai
  from cut group by all)"""


def loss_sql() -> str:
    clamp = "greatest(1e-7, least(1 - 1e-7, {}))"
    s = clamp.format("score")
    p = clamp.format(f"1 / (1 + exp(-ln({s} / (1 - {s})) / t))")
    return rows_sql() + f""",
counts as (select y, score, count(*) k from rows_ group by all),
grid as (select 0.1::double + 0.05::double * i t from range(0, {len(O.temperatures())}) r(i)),
losses as (select t temperature, round(sum(-ln(case when y = 1 then {p} else 1 - {p} end) * k), 6) loss from counts cross join grid group by 1),
fit as (select * from losses order by loss, temperature limit 1)"""


def oracle_sql() -> dict[str, str]:
    points = "case when score <= 0 then 0.05 " + " ".join(f"when score <= {x1} then {y0} + (score - {x0}) * (({y1}::double - {y0}) / ({x1}::double - {x0}))" for (x0, y0), (x1, y1) in zip(POINTS, POINTS[1:])) + f" else {POINTS[-1][1]} end"
    s = "greatest(1e-7, least(1 - 1e-7, score))"
    names = "auroc auprc tpr_at_fpr5 human_fpr mean_score_human mean_score_ai calibration_error".split()
    return {
        "slice_metrics": cut_sql("lang", "toxic") + " select dimension, value, n_samples, " + ", ".join(f"round({n}, 6) {n}" for n in names) + " from basic join ranked using (dimension, value) join ece using (dimension, value)",
        "auroc_by_lang": cut_sql("lang", overall=False) + " select value lang, round(auroc, 6) auroc from ranked",
        "ap_by_lang": cut_sql("lang", overall=False) + " select value lang, round(auprc, 6) auprc from ranked",
        "tpr_at_fpr5": cut_sql("lang") + " select dimension, value, round(tpr_at_fpr5, 6) tpr_at_fpr5 from ranked",
        "calibration_error": cut_sql("source") + " select dimension, value, round(calibration_error, 6) calibration_error from ece",
        "human_fpr": cut_sql("lang") + " select dimension, value, round(human_fpr, 6) human_fpr from basic",
        "threshold_table": rows_sql() + f" select threshold, round(avg(case when y = 1 then (score >= threshold)::int end), 6) tpr, round(avg(case when y = 0 then (score >= threshold)::int end), 6) fpr from rows_ cross join (select unnest({list(THRESHOLDS)}::double[]) threshold) group by 1",
        "temperature_fit": loss_sql() + " select round(temperature, 6) temperature, round(loss, 4) loss from fit",
        "calibrated_scores": loss_sql() + f" select doc_id, score, round(1 / (1 + exp(-ln({s} / (1 - {s})) / temperature)), 6) confidence from rows_ cross join fit",
        "isotonic_interp": rows_sql() + f" select doc_id, round({points}, 6) calibrated from rows_",
        "intensity_bucket": """
with b as (select least(trunc((value / 500.0::double) / (1::double / 5))::int, 4) i from events)
select format('{:.2f}-{:.2f}', i * (1::double / 5), (i + 1) * (1::double / 5)) bucket, count(*) n from b group by 1""",
        "detector_grid": "select doc_id, detector, 0.5::double score, 'ambiguous' predicted_label from documents cross join (values ('classifier'), ('statistical')) t(detector)",
        "score_summary": rows_sql() + f""",
c as (select *, case when score <= {C.HUMAN_MAX} then 'human' when score >= {C.AI_MIN} then 'ai_generated' else 'ambiguous' end c from rows_)
select lang, count(*) total, count(*) filter (c = 'human') human, count(*) filter (c = 'ambiguous') ambiguous, count(*) filter (c = 'ai_generated') ai_only,
  count(*) filter (c <> 'human') ai_or_ambiguous, round(avg(score), 6) mean, min(score) least, max(score) most from c group by 1""",
    }


QUERIES = {f.__name__: f for f in (slice_metrics, auroc_by_lang, ap_by_lang, tpr_at_fpr5, calibration_error, human_fpr, threshold_table, temperature_fit, calibrated_scores, isotonic_interp, intensity_bucket, detector_grid, score_summary)}
