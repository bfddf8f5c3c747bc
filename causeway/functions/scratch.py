"""Places for intermediate files."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Paths that scratch_path gave and that still stand.
MADE: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the session names in spark.checkpoint.dir, shared by all executors; where it is unset, a local one in local mode, else RuntimeError."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        root = "file://" + tempfile.mkdtemp(dir="/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir(root)
    MADE.append(f"{root.rstrip('/')}/{uuid.uuid4().hex}/{name}")
    return MADE[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to a fresh path and reads it back: it cuts lineage, survives lost executors, and Spark knows its size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """For a step of a loop whose result the caller holds when it ends: tables stored within are removed at the end, and a job's shuffle files with the job, so steps don't add up on disk."""
    made, before = len(MADE), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
        for path in MADE[made:]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        del MADE[made:]


@contextmanager
def batches_by_rows(spark: SparkSession) -> Iterator[None]:
    """For jobs that hand rows of a few numbers to Python: batches are limited by their rows alone, else Spark works out their bytes anew for every row."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(2**31 - 1))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it counts at most ``rows`` rows (narrow ones: keys and numbers); else as it is, and Spark decides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
