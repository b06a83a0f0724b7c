"""Progress of a run as a table that can be written again without doubling anything.

A batch of results lies in a folder of its own (generation, stage, batch) and replaces what that folder held, so a batch that is given
twice, as foreachBatch may do after a failure, leaves its rows once. A result is known by (stage, digest, chunk_id); of several batches
the highest one counts, and in a batch the last by the results' order as JSON. `compact` keeps what counts, in a new generation that readers
see once it is complete; `clear` removes all.

One writer at a time is assumed. Cases: results whose digest is not that of a document any more are not loaded; a folder that is not
there holds nothing; an empty batch replaces what it held before with nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "digest string, chunk_id string, result string, saved_at timestamp, batch long"


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    system, at = _place(spark, path)
    return [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []


def _complete(spark: SparkSession, path: str) -> list[int]:
    """Generations that can be read: the first one, and those whose compaction has ended."""
    found = [int(m[1]) for n in _names(spark, path) if (m := re.fullmatch(r"generation=(\d+)", n))]
    return sorted(g for g in found if g == 0 or "_COMPLETE" in _names(spark, f"{path}/generation={g}"))


def _folder(spark: SparkSession, path: str) -> str:
    return f"{path}/generation={max(_complete(spark, path), default=0)}"


def exists(spark: SparkSession, path: str, stage: str | None = None) -> bool:
    """Whether anything was saved, for a stage or at all."""
    stages = [n for n in _names(spark, _folder(spark, path)) if n.startswith("stage=")]
    return bool(stages) if stage is None else f"stage={stage}" in stages


def clear(spark: SparkSession, path: str) -> None:
    """Removes all progress."""
    system, at = _place(spark, path)
    system.delete(at, True)


def batches(spark: SparkSession, path: str, stage: str) -> list[int]:
    """Numbers of a stage's batches."""
    return sorted(int(n.removeprefix("batch=")) for n in _names(spark, f"{_folder(spark, path)}/stage={stage}") if n.startswith("batch="))


def save(results: DataFrame, path: str, stage: str, batch: int | None = None) -> int:
    """Saves results (digest, chunk_id, ...) as one batch, by default the next one, and returns its number."""
    spark = results.sparkSession
    if batch is None:
        batch = max(batches(spark, path, stage), default=-1) + 1
    rows = results.select("digest", "chunk_id", F.to_json(F.struct(*[F.col(f"`{c}`") for c in results.columns])).alias("result"), F.current_timestamp().alias("saved_at"))
    rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{_folder(spark, path)}/stage={stage}/batch={batch}")
    return batch


def _latest(rows: DataFrame, *keys: str) -> DataFrame:
    best = F.max_by(F.struct("result", "saved_at", "batch"), F.struct("batch", "saved_at", "result"))
    return rows.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def _read(spark: SparkSession, folder: str, found: list[int]) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(*[f"{folder}/batch={b}" for b in found]) if found else spark.createDataFrame([], SCHEMA)


def load(spark: SparkSession, path: str, docs: DataFrame, stage: str) -> DataFrame:
    """digest, chunk_id and result (JSON) of what counts, for documents (digest) that have not changed since."""
    rows = _read(spark, f"{_folder(spark, path)}/stage={stage}", batches(spark, path, stage))
    valid = rows.join(docs.select("digest").distinct(), "digest", "left_semi")
    return _latest(valid, "digest", "chunk_id").select("digest", "chunk_id", "result")


def compact(spark: SparkSession, path: str) -> int:
    """Writes what counts as a new generation, drops the older ones, and returns the number of rows. Numbers of batches stay, so one that is
    given again after it still replaces its own rows."""
    before = _complete(spark, path)
    old = _folder(spark, path)
    new = f"{path}/generation={max(before, default=0) + 1}"
    clear(spark, new)  # of a compaction that did not end
    total = 0
    for stage in [n.removeprefix("stage=") for n in _names(spark, old) if n.startswith("stage=")]:
        numbers = batches(spark, path, stage)
        rows = _latest(_read(spark, f"{old}/stage={stage}", numbers), "digest", "chunk_id")
        target = f"{new}/stage={stage}/batch={max(numbers)}"
        rows.write.parquet(target)
        total += spark.read.parquet(target).count()
    system, at = _place(spark, f"{new}/_COMPLETE")
    system.create(at, True).close()
    for g in before:
        clear(spark, f"{path}/generation={g}")
    return total


def save_stream(results: DataFrame, path: str, stage: str, checkpoint: str):
    """Saves a stream of results batch by batch, under the stream's own numbers; what is there is taken and the query ends."""

    def each(rows: DataFrame, number: int) -> None:
        save(rows, path, stage, number)

    return results.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
