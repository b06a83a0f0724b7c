"""The corpus pipeline: quality rules, near-duplicates, repeated strings, mixing of sources, tokens.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame
that is written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bpe, minhash_dedup, quality_rules, source_mixing, suffix_dedup
from loomtext.llm.common import delete, finish, owning, settled, shared_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_filter(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash_dedup.near_dedup(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that earlier ones hold; n_chars follows the text."""
    out = suffix_dedup.deduplicated(docs)
    if "n_chars" not in out.columns:
        return out
    return owning(out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)), lambda: finish(out))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return source_mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of each document's tokens and of their decoded text."""
    return bpe.encode_decode(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("near-duplicates", drop_near_copies),
    ("repeated strings", cut_repeats),
    ("source mixing", mix_sources),
    ("BPE encoding", encode),
]

#: SQL cannot express the merges of the last stage; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's result lies in the shared folder until the next one is written; the last one's rows are returned settled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for number, (_, stage) in enumerate(STAGES[:-1]):
            result = stage(spark, docs, sf_dir)
            try:
                result.write.parquet(f"{base}/{number}")
            finally:
                finish(result)
            docs = spark.read.parquet(f"{base}/{number}")
            if number:
                delete(spark, f"{base}/{number - 1}")
        return settled(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        delete(spark, base)
