"""Documents scored as they arrive: a file stream, scores without state, an append per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import features, scoring


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, stat_score and class. No state and no shuffle, so it runs on streams as on tables."""
    out = features.stat_score(docs).withColumn("stat_score", F.round("stat_score", 6))
    return out.select("doc_id", "stat_score", scoring.label(F.col("stat_score")).alias("classification"))


def score_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id long, text string"):
    """Scores Parquet files that appear in `source` and appends to `target`; the checkpoint says which ones are done."""
    docs = spark.readStream.schema(schema).parquet(source)
    return scored(docs).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
