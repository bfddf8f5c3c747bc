"""What several corpus operators share: text folding, word splitting, tables in the shared folder, size-checked broadcasts, batches cut by bytes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Everything that is not a word character: ASCII controls, blanks and punctuation (after folding, no capitals are left).
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes up to which a table is broadcast; beyond either Spark shuffles both sides.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Rows of an Arrow batch between Spark and Python: texts are some kilobytes each, so Spark's 10,000 would be tens of megabytes a copy.
ARROW_ROWS = 1000
#: Bytes of text that Python works on at a time.
SLICE_BYTES = 1 << 20
#: Paths of intermediate tables of this process, oldest first.
MADE: list[str] = []


def fold(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; pure-ASCII texts take the fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.array_remove(F.split(fold(F.coalesce(text, F.lit(""))), GAPS), "")


def text_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ARROW_ROWS rows, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``most`` bytes of the column's texts, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(int(np.searchsorted(upto, done + most, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start, done = stop, int(upto[stop - 1])
        pa.default_memory_pool().release_unused()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; where it is unset, a local one in local mode (tests), else RuntimeError."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        where = "file://" + tempfile.mkdtemp(dir="/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It is noted in MADE, so that a caller who is done with what was written can remove it."""
    MADE.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders that fresh_path named."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        MADE.remove(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: it cuts lineage, survives lost executors, and Spark knows its size."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(df: DataFrame) -> Column:
    """About the bytes of a row of df."""
    out = F.lit(0)
    for f in df.schema:
        kind, col = f.dataType.simpleString(), F.col(f"`{f.name}`")
        own = F.octet_length(col) if kind in ("string", "binary") else F.octet_length(F.array_join(col, "")) + 8 * F.size(col) if kind == "array<string>" else 8 * F.size(col) if kind.startswith("array") else F.lit(8)
        out = out + F.coalesce(own, F.lit(0))
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows and ``most`` bytes; else as it is. For stored tables, which are cheap to count."""
    if df.limit(rows + 1).count() > rows:
        return df
    return F.broadcast(df) if (df.agg(F.sum(width(df))).first()[0] or 0) <= most else df


def hashed_sample(df: DataFrame, by: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows of df, those with the smallest hash of the columns by. Hashes too large to be among them are dropped before the sort."""
    n, h = df.count(), F.xxhash64(*by)
    if n > 2 * rows:
        df = df.filter(h <= int((1.5 * rows / n - 0.5) * (1 << 64)))
    return df.orderBy(h, *by).limit(rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
