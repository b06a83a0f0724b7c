"""The folder that driver and executors share, results that are computed once and kept there, and what Python holds at once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or a folder in the warehouse where that is unset."""
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return jsc.getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """The same rows without lineage; Spark's cleaner drops them with the last plan that needs them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows that Python gets at once, and bytes of texts that it turns into its own objects at once.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1_000, 1 << 20
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same rows. From now on the session hands ROWS_AT_ONCE rows to Python at once, unless it has a number of its own."""
    if df.sparkSession.conf.get(_ROWS) == "10000":
        df.sparkSession.conf.set(_ROWS, str(ROWS_AT_ONCE))
    return df


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have up to BYTES_AT_ONCE together; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and total + size > BYTES_AT_ONCE:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)
