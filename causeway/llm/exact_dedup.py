"""Operator 13, exact dedup: a streaming query with keyed state on disk that never expires; full bytes are compared on hits.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest id stays.

1. ``follow`` reads the files of a table as a stream. Every row becomes a digest of its text, its id and the place of its content (file, row in the file).
   The state, kept by RocksDB and saved to the shared folder, has a row a digest: how many rows had it, and the id and place of the one that stays. Rows
   are combined map-side before they reach the state, so a digest of a third of all rows is one row a task. No watermark: nothing expires. Each micro-batch
   writes the digests it changed; a batch that is run again overwrites its own folder.
2. ``verified`` takes the digests met more than once (hits), reads their texts again and compares all bytes: rows of one digest are grouped by their
   whole text, map-side first. The content at the retained place stands for the digest; digests with another content beside it are collisions.
3. ``members`` joins rows with the state by digest (narrow rows, a join that Spark can split). Rows of collided digests are grouped by digest and text.

Texts of no hit never shuffle unless there are more hits than a broadcast may hold (then Spark joins by digest, with its runtime filters). Called again
with the same home, ``follow`` reads only files that are new since, so a table can be fed for as long as it grows; files may be added, not changed.

Cases: a null or empty text is the empty text; very long texts are digested and compared whole; of equal texts with equal ids the one later by file and row
stays, so just one row of a group is kept; rows without an id stay only if their group has no other; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import fold, fresh_path, small, stored

#: State on disk, saved as changes; its caches share one bound on every executor, and stores of a few rows claim no disk ahead.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings; afterwards as it was."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exists(spark: SparkSession, path: str, as_file: bool = False) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(at) and not (as_file and system.getFileStatus(at).isDirectory())


def contents(rows: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(digest, at: struct of id, file, row; content) of a table that is read from Parquet files."""
    place = F.struct(F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = rows.select(place.alias("at"), fold(F.coalesce(F.col(text_col), F.lit(""))).alias("content"))
    return rows.select(digest(F.col("content")).alias("digest"), "at", "content")


def follow(spark: SparkSession, path: str, home: str, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> None:
    """Brings the state in home up to date with the files of path: reads what is new since the last call."""
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    seen = f"{path[:-1]}[{path[-1]}]" if exists(spark, path, as_file=True) else path  # streams read folders or patterns; a pattern may name a single file
    keys = contents(source.parquet(seen), id_col, text_col, digest).groupBy("digest").agg(F.count("*").alias("n"), F.max("at").alias("keep"))
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{home}/keys/batch={number}")
    with settings(spark, STATE):
        keys.writeStream.outputMode("update").foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{home}/checkpoint").start().awaitTermination()


def known(rows: DataFrame, home: str) -> DataFrame:
    """(digest, n, keep): the state as the micro-batches wrote it, the latest row of each digest. rows: of contents."""
    spark = rows.sparkSession
    kept = f"{rows.schema['digest'].dataType.simpleString()}, n long, keep {rows.schema['at'].dataType.simpleString()}"
    if not exists(spark, f"{home}/keys"):
        return spark.createDataFrame([], f"digest {kept}")
    changes = spark.read.schema(f"digest {kept}, batch long").parquet(f"{home}/keys")
    return changes.groupBy("digest").agg(F.max(F.struct("batch", "n", "keep")).alias("x")).select("digest", "x.n", "x.keep")


def verified(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(digest, same): whether all rows of the digest have the bytes at the place that the state retained. For hits only."""
    hits = keys.filter("n > 1").select(F.col("digest").alias("hit"), F.col("keep").alias("retained"))
    met = rows.join(small(stored(hits, "hits")), F.col("digest") == F.col("hit"))
    each = met.groupBy("digest", "content").agg(F.max((F.col("at") == F.col("retained")).cast("int")).alias("retained"))
    return each.groupBy("digest").agg((F.min("retained") == 1).alias("same"))


def members(rows: DataFrame, keys: DataFrame, checked: DataFrame) -> DataFrame:
    """(at, digest, keep, n, content): every row with the place of the row that stays and the size of its group; content is null but for collided digests."""
    collided = stored(checked.filter("not same").select(F.col("digest").alias("hit")), "collided")
    narrow = rows.select("digest", "at")
    if collided.isEmpty():
        return narrow.join(keys, "digest").select("at", "digest", "keep", "n", F.lit(None).cast("string").alias("content"))
    hit = F.col("digest") == F.col("hit")
    sure = narrow.join(collided, hit, "left_anti").join(keys, "digest").select("at", "digest", "keep", "n", F.lit(None).cast("string").alias("content"))
    rest = rows.join(small(collided), hit).select("digest", "at", "content")
    groups = rest.groupBy("digest", "content").agg(F.count("*").alias("n"), F.max("at").alias("keep"))
    return sure.unionByName(rest.join(groups, ["digest", "content"]).select("at", "digest", "keep", "n", "content"))


def duplicates_in(spark: SparkSession, path: str, *, home: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) for every row of the Parquet table at path.

    home: where state and progress live; a folder that all executors share. Given again after files were added, only those are read into the state.
    """
    home = home or fresh_path(spark, "exact-dedup")
    follow(spark, path, home, id_col=id_col, text_col=text_col, digest=digest, files_per_batch=files_per_batch)
    rows = contents(spark.read.parquet(path), id_col, text_col, digest)
    keys = stored(known(rows, home), "keys")
    out = members(rows, keys, verified(rows, keys))
    return out.select(F.col("at.id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("keep")).alias("kept"), "digest")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """duplicates_in for any table: its ids and texts are written to the shared folder first."""
    path = fresh_path(docs.sparkSession, "texts")
    docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).write.parquet(path)
    return duplicates_in(docs.sparkSession, path, id_col="id", **options).withColumnRenamed("id", id_col)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates_in(spark, f"{sf_dir}/documents.parquet").withColumnRenamed("digest", "text_sha256")


OP13_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY folded) AS keep_id, count(*) OVER (PARTITION BY folded) AS group_size,
  row_number() OVER (PARTITION BY folded ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(folded) AS text_sha256
FROM t
"""
