"""Small helpers shared by the operators: shared storage, checked broadcasts, batch building."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or a folder in the warehouse where that is unset."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    spark.sparkContext.setCheckpointDir(path)
    return jsc.getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder, without lineage.

    Spark's cleaner drops them with the last plan that needs them, if spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished rounds: it acts when the driver collects its garbage, which rarely happens by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows that Python gets at once. Texts are long, and Spark's default of 10,000 rows takes an executor's memory twice, in the JVM and in Python.
ROWS_AT_ONCE = 1_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same rows. From now on the session hands ROWS_AT_ONCE rows to Python at once, unless it has a number of its own."""
    if df.sparkSession.conf.get(_ROWS) == "10000":
        df.sparkSession.conf.set(_ROWS, str(ROWS_AT_ONCE))
    return df


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder on any file system that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def with_row(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and, in the struct `row`, all columns of docs: whatever they are called, they clash with nothing."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


#: What drops the tables of lazy results that nobody has finished yet.
_unfinished: list = []


def owning(result: DataFrame, drop) -> DataFrame:
    """The same result, of which `drop` removes the tables that it reads lazily. It is called by `finish`, or when Python exits."""
    result.__dict__["_loomtext_drop"] = drop
    _unfinished.append(drop)
    return result


def finish(result: DataFrame) -> None:
    """Drops the tables that a result depends on, and no other result's. Callers do so after writing it."""
    drop = result.__dict__.pop("_loomtext_drop", None)
    if drop is not None:
        _unfinished.remove(drop)
        drop()


@atexit.register
def _finish_all() -> None:
    while _unfinished:
        with contextlib.suppress(Exception):  # the session may have ended
            _unfinished.pop()()


class Table:
    """A Parquet table in the shared folder that its maker drops as soon as it is read for the last time."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows. It counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def salted(df: DataFrame, small_side: DataFrame, on: list[str], salts: int, by: Column, bound: int) -> DataFrame:
    """Left join of df with a table of one row per key.

    A table of up to `bound` rows, counted beforehand, is broadcast. A larger one is copied `salts` times and joined by key and
    salt, so that a key with a third of all rows is dealt to as many tasks. Null keys match null keys.
    """
    if small(small_side, bound):
        right = F.broadcast(small_side.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in small_side.columns if c not in on]))
        cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    else:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
        right = small_side.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in small_side.columns if c not in on])
        right = right.withColumn("_r__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in [*on, "_salt"]]
    together = cond[0]
    for c in cond[1:]:
        together &= c
    return df.join(right, together, "left").drop("_salt", *[c for c in right.columns if c.startswith("_r_")])


def sub_batches(batch: pa.RecordBatch, column: str, limit: int):
    """Slices of a batch whose texts have about `limit` bytes together; a longer text makes a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start, total = np.cumsum(sizes), 0, len(sizes)
    while start < total:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
