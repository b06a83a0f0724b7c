"""Quality of scores against labels, per slice: one pass over rows that carry (dimension, value) of every slice they belong to.

Input rows: y (0 or 1), score, and the columns that slices are cut by. The overall slice has the dimension 'overall' and value 'all'.
Ranking metrics are computed from counts per distinct score, so windows hold one row per slice and score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The dimensions of experiments.
DIMENSIONS = ("detector", "document_format", "domain", "intensity_bucket", "operator", "source_class", "source_model")
BINS = 10
TARGET_FPR = 0.05


def sliced(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value, y, score: each row once per slice; null values belong to no slice."""
    keys = [F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("value"))]
    keys += [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]
    rows = rows.select("y", "score", F.explode(F.array(*keys)).alias("k")).filter("k.value is not null")
    return rows.select("k.dimension", "k.value", "y", "score")


def legal(dimensions: list[str]) -> list[str]:
    """The dimensions of an experiment, with an error for one that experiments do not have."""
    if odd := [d for d in dimensions if d not in DIMENSIONS]:
        raise ValueError(f"invalid dimension {odd[0]!r}; valid ones are {', '.join(DIMENSIONS)}")
    return dimensions


def curve(cut: DataFrame) -> DataFrame:
    """Per slice and distinct score, highest first: positives and negatives at it and up to it, and in all."""
    counts = cut.groupBy("dimension", "value", "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    part = W.partitionBy("dimension", "value")
    down = part.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    return counts.select("*", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(part).alias("p"), F.sum("neg").over(part).alias("n"))


def ranking(points: DataFrame) -> DataFrame:
    """auroc, auprc and tpr_at_fpr5 per slice; null where a class is missing."""
    both = (F.col("p") > 0) & (F.col("n") > 0)
    part = W.partitionBy("dimension", "value").orderBy(F.desc("score"))
    points = points.withColumn("tpr", F.try_divide("tp", "p")).withColumn("fpr", F.try_divide("fp", "n"))
    points = points.withColumn("tpr0", F.coalesce(F.lag("tpr").over(part), F.lit(0.0))).withColumn("fpr0", F.coalesce(F.lag("fpr").over(part), F.lit(0.0)))
    # A negative loses to the positives above it and half of those at its score.
    area = F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), F.max(F.col("p") * F.col("n")))
    steps = F.sum((F.col("tpr") - F.col("tpr0")) * F.try_divide("tp", F.col("tp") + F.col("fp")))
    # The point before the target with the largest rates, and the first one beyond it.
    low = F.max(F.when(F.col("fpr") <= TARGET_FPR, F.struct("fpr", "tpr")))
    high = F.min(F.when(F.col("fpr") > TARGET_FPR, F.struct("fpr", "tpr")))
    out = points.groupBy("dimension", "value").agg(F.max(both).alias("both"), area.alias("auroc"), steps.alias("auprc"), low.alias("low"), high.alias("high"))
    x0, y0 = F.coalesce("low.fpr", F.lit(0.0)), F.coalesce("low.tpr", F.lit(0.0))
    at = F.when((x0 == TARGET_FPR) | F.col("high").isNull(), y0).otherwise(y0 + (TARGET_FPR - x0) * (F.col("high.tpr") - y0) / (F.col("high.fpr") - x0))
    keep = lambda c, name: F.when(F.col("both"), c).alias(name)
    return out.select("dimension", "value", keep(F.col("auroc"), "auroc"), keep(F.col("auprc"), "auprc"), keep(at, "tpr_at_fpr5"))


def bin_of(score: Column) -> Column:
    """The bin by edges i * 0.1 in double precision; the last one is closed. Dividing would misplace scores at edges."""
    out = F.lit(BINS - 1)
    for i in range(BINS - 1, 0, -1):
        out = F.when(score < F.lit(i * 0.1), i - 1).otherwise(out)
    return out


def calibration_error(cut: DataFrame) -> DataFrame:
    bins = cut.groupBy("dimension", "value", bin_of(F.col("score")).alias("bin")).agg(F.count("*").alias("k"), F.avg("y").alias("acc"), F.avg("score").alias("conf"))
    return bins.groupBy("dimension", "value").agg((F.sum(F.col("k") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("k")).alias("calibration_error"))


def basics(cut: DataFrame) -> DataFrame:
    human = F.when(F.col("y") == 0, F.col("score"))
    return cut.groupBy("dimension", "value").agg(
        F.count("*").alias("n_samples"),
        F.avg(F.when(F.col("y") == 0, (F.col("score") > 0.5).cast("double"))).alias("human_fpr"),
        F.avg(human).alias("mean_score_human"), F.avg(F.when(F.col("y") == 1, F.col("score"))).alias("mean_score_ai"),
    )


def slice_metrics(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """All metrics per slice. One row per slice is joined at the end."""
    cut = sliced(rows, dimensions)
    keys = ["dimension", "value"]
    return basics(cut).join(ranking(curve(cut)), keys).join(calibration_error(cut), keys)


def intensity_bucket(value: Column, buckets: int = 5) -> Column:
    """'0.40-0.60' and the like; the division is in double precision on purpose."""
    width = 1.0 / buckets
    i = F.least((value / F.lit(width)).cast("int"), F.lit(buckets - 1))
    return F.format_string("%.2f-%.2f", i * F.lit(width), (i + 1) * F.lit(width))


def temperatures() -> list[float]:
    return [0.1 + 0.05 * i for i in range(98)]


def temperature_losses(rows: DataFrame) -> DataFrame:
    """temperature and loss (negative log-likelihood of y) over the grid. Rows of one score and label are counted first."""
    from loomtext.functions.scoring import clamped, temperature_scaled

    counts = rows.groupBy("y", "score").agg(F.count("*").alias("k"))
    grid = counts.withColumn("temperature", F.explode(F.array(*[F.lit(t) for t in temperatures()])))
    p = clamped(temperature_scaled(F.col("score"), F.col("temperature")))
    loss = -F.ln(F.when(F.col("y") == 1, p).otherwise(1 - p)) * F.col("k")
    return grid.groupBy("temperature").agg(F.sum(loss).alias("loss"))


def fit_temperature(rows: DataFrame, digits: int = 6) -> DataFrame:
    """The temperature of least loss; of equal losses (to `digits`) the smallest temperature. One row."""
    losses = temperature_losses(rows).withColumn("loss", F.round("loss", digits))
    return losses.orderBy("loss", "temperature").limit(1)
