"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing, sharding. Each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import MADE, removed, small, stored, table, words
from causeway.llm.decontaminate import find_contamination
from causeway.llm.mixing import mix_sources
from causeway.llm.near_dup import near_duplicates
from causeway.llm.sharding import shard_by_curve
from causeway.llm.toxicity import reject_toxic, trained


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the model learns from labelled rows outside fold 0."""
    return reject_toxic(docs, trained(spark, sf_dir))


def unused(docs: DataFrame, name: str) -> str:
    """name, made longer until docs has no such column."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def told_apart(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and the column that tells its rows apart: doc_id if no two rows share one (null included), else a number that is stored with them."""
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs, "doc_id"
    key = unused(docs, "row")
    return stored(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def without(docs: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """The rows of docs whose key is not among keys (one column, of that name)."""
    own = unused(docs, name)
    return docs.join(small(keys.select(F.col(key).alias(own))), F.col(key).eqNullSafe(F.col(own)), "left_anti")


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each near-duplicate class (null ids last); of wordless rows with one id and text, one."""
    cols = docs.columns
    docs, key = told_apart(docs)
    classes = near_duplicates(docs.select(F.col(key).alias("key"), "text"), id_col="key")
    if key == "doc_id":
        gone = classes.filter(~F.col("key").eqNullSafe(F.col("class_id")))
    else:
        bare = (F.size(words(F.col("text"))) == 0) & F.col("doc_id").isNotNull()
        rows = docs.select(F.col(key).alias("row"), "doc_id", F.when(bare, F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"))).alias("bare"))
        rows = stored(classes.join(rows, F.col("key") == F.col("row")).withColumn("class_id", F.when(F.col("bare").isNull(), F.col("class_id"))).select("key", "doc_id", "class_id", "bare"), "classes")
        first = rows.groupBy("class_id", "bare").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"].alias("first"))
        gone = rows.join(first, F.col("key") == F.col("first"), "left_anti")
    return without(docs, stored(gone.select(F.col("key").alias(key)), "copies"), key, "gone").select(*cols)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    cols = docs.columns
    docs, key = told_apart(docs)
    hit = find_contamination(docs.select(F.col(key).alias("key"), "text"), table(spark, sf_dir, "benchmark"), id_col="key").filter("n_hit > 0")
    return without(docs, stored(hit.select(F.col("key").alias(key)), "contaminated"), key, "hit").select(*cols)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    cols, other, times, copy = docs.columns, unused(docs, "mixed"), unused(docs, "times"), unused(docs, "copy")
    docs, key = told_apart(docs)
    mixed = mix_sources(docs.select(F.col(key).alias("key"), "text", "source"), id_col="key").filter("copies > 0").select(F.col("key").alias(other), F.col("copies").alias(times))
    return docs.join(mixed, F.col(key).eqNullSafe(F.col(other))).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*cols)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row, in Hilbert order."""
    return shard_by_curve(docs, 8).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_each_class),
    ("decontamination", drop_contaminated),
    ("mixing", mix_to_weights),
    ("sharding", to_shards),
]

#: SQL can express neither the toxicity scores nor the mix; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each stored for the next; what a stage wrote on the way is removed when its result is stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = len(MADE)
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        removed(spark, MADE[made:-1])
    return docs
