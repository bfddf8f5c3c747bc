"""Operator 2, line dedup: two Bloom filters for once-seen and twice-seen lines; only suspected repeats shuffle.

A line's key is the line without blanks at its ends, A-Z lower-cased. A key of at least ``min_chars`` code points found in two documents
keeps its lines in the smallest id that holds it and loses them elsewhere.

1. Every task fills its own pair of bitmaps: ``once`` for keys it met, ``twice`` for keys it met again in another document. Pairs merge
   by twice = t1 | t2 | (o1 & o2), once = o1 | o2, which loses no repeat; they merge block by block, streamed, in parallel.
2. The merged ``twice`` bitmap goes to all tasks. Its size follows the number of lines up to ``max_bits`` (64 MB), a fixed bound: beyond
   it more lines are suspected, none is missed, and the result stays exact.
3. One pass over the texts marks each with its suspected keys and stores it under a row number.
4. Suspected lines alone shuffle, with their whole key: min and max id a key (combined map-side, so one line in a third of all documents is one row
   a task) confirm the repeats and choose the first; the join that tells rows which of their keys are lost is one that Spark can split.
5. Lost keys meet their rows by row number, so what is gathered is what one text holds, whatever its id. Texts without a suspected line never shuffle.

Cases: a null or empty text is one empty line; very long texts are split whole, one at a time; rows of one id are one document when repeats are counted; rows
without an id count as one document behind all others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import by_bytes, small, stored, table, text_batches

BLANKS = b" \t\n\x0b\x0c\r"
#: Bits of a block, the unit in which bitmaps merge.
BLOCK = 1 << 19


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, None if it is too short to count."""
    key = line.strip(BLANKS)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return key.lower()  # of bytes: A-Z only


def probes(hashes: np.ndarray, bits: int, k: int) -> np.ndarray:
    """k bit numbers (rows) of each hash (columns)."""
    step = (hashes >> np.uint64(17)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    return np.stack([((hashes + np.uint64(i) * step) >> np.uint64(3)) & np.uint64(bits - 1) for i in range(k)]).astype(np.int64)


def has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=0)


def put(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, (at >> 3).ravel(), np.left_shift(1, at & 7).astype(np.uint8).ravel())


def filter_shape(lines: int, bits_per_line: int, max_bits: int) -> tuple[int, int]:
    """Bits (a power of two) and probes a key."""
    bits = BLOCK
    while bits < lines * bits_per_line and bits < max_bits:
        bits *= 2
    return bits, max(1, min(4, bits // max(lines, 1) // 4))


def twice_seen(docs: DataFrame, lines: int, min_chars: int, bits_per_line: int, max_bits: int) -> tuple[np.ndarray, int]:
    """The merged bitmap of keys met in two documents, and its probes a key. docs: k (id as long), text."""
    bits, k = filter_shape(lines, bits_per_line, max_bits)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in by_bytes(batches, "text"):
            found = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found += {xxhash.xxh3_64_intdigest(key) for line in text.split(b"\n") if (key := line_key(line, min_chars))}
            hashes, counts = np.unique(np.array(found, dtype=np.uint64), return_counts=True)
            at = probes(hashes, bits, k)
            put(twice, at[:, has(once, at) | (counts > 1)])
            put(once, at)
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in range(bits // BLOCK):
            o, t = (x[b * BLOCK // 8 : (b + 1) * BLOCK // 8] for x in (once, twice))
            if o.any():
                yield pa.RecordBatch.from_pydict({"block": [b], "once": [pack(o.tobytes())], "twice": [pack(t.tobytes())]}, schema=pa.schema([("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        unpack = lambda x: np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
        for batch in batches:
            for row in batch.to_pylist():
                o, t = unpack(row["once"]), unpack(row["twice"])
                if row["block"] in met:
                    o1, t1 = met[row["block"]]
                    o, t = o | o1, t | t1 | (o & o1)
                met[row["block"]] = o, t
        pack = zstandard.ZstdCompressor(level=1).compress
        for b, (_, t) in met.items():
            yield pa.RecordBatch.from_pydict({"block": [b], "twice": [pack(t.tobytes())]}, schema=pa.schema([("block", pa.int32()), ("twice", pa.binary())]))

    parts = docs.select("text").mapInArrow(partial, "block int, once binary, twice binary")
    whole = np.zeros(bits // 8, np.uint8)
    for row in parts.repartition("block").mapInArrow(merge, "block int, twice binary").toLocalIterator():
        whole[row["block"] * BLOCK // 8 : (row["block"] + 1) * BLOCK // 8] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["twice"])), np.uint8)
    return whole, k


def dedup_lines(docs: DataFrame, *, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", bits_per_line: int = 16, max_bits: int = 1 << 29) -> DataFrame:
    """(id, n_lines, n_dropped, kept) for every row of docs; kept: the remaining lines joined by newline."""
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    bitmap, n_probes = twice_seen(docs, lines, min_chars, bits_per_line, max_bits)
    sent = spark.sparkContext.broadcast(bitmap)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            keys = [list({key for line in text.split(b"\n") if (key := line_key(line, min_chars))}) for text in batch.column("text").cast(pa.binary()).to_pylist()]
            flat = [key for own in keys for key in own]
            flags = iter(has(sent.value, probes(np.array([xxhash.xxh3_64_intdigest(x) for x in flat], dtype=np.uint64), sent.value.size * 8, n_probes)).tolist() if flat else [])
            found = [[key for key in own if next(flags)] for own in keys]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("text"), pa.array(found, pa.list_(pa.binary()))], ["row", "id", "text", "keys"])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            out = []
            for text, lost in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lost").to_pylist()):
                own = text.split(b"\n")
                lost = set(lost or ())
                kept = [x for x in own if (key := line_key(x, min_chars)) is None or xxhash.xxh3_128_digest(key) not in lost] if lost else own
                out.append((len(own), len(own) - len(kept), b"\n".join(kept)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()).cast(pa.string())], ["id", "n_lines", "n_dropped", "kept"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([xxhash.xxh3_128_digest(x) for x in batch.column("key").to_pylist()], pa.binary())], ["row", "digest"])

    marked = stored(docs.select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(mark, "row long, id long, text string, keys array<binary>"), "marked-texts")
    found = marked.select("row", "id", F.explode("keys").alias("key"))
    repeats = found.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("id").isNull().cast("int")).alias("none"))
    repeats = stored(repeats.filter((F.col("first") < F.col("last")) | (F.col("first").isNotNull() & (F.col("none") == 1))).select("key", "first"), "repeated-lines")
    lost = found.join(repeats, "key").filter(F.col("id").isNull() | (F.col("id") > F.col("first"))).select("row", "key").mapInArrow(digest, "row long, digest binary")
    lost = lost.groupBy("row").agg(F.collect_list("digest").alias("lost"))
    schema = "id long, n_lines long, n_dropped long, kept string"
    whole = marked.filter(F.size("keys") == 0).select("id", (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept"))
    cut = marked.filter(F.size("keys") > 0).select("row", "id", "text").join(lost, "row", "left").mapInArrow(drop, schema)
    return whole.unionByName(cut).withColumnRenamed("id", id_col)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeats AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, r.first IS NOT NULL AND k.doc_id > r.first AS lost FROM keyed k LEFT JOIN repeats r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
