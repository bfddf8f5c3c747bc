"""Operator 3, exact top-k search: columnar branch and bound on integer inner products.

Query rows are numbered and stored; a block of them (``block`` rows, ``BLOCK_BYTES`` at most, so its size is bounded whatever the input) goes to
all tasks, and every task streams its own part of the vectors past it in vertical packs (a row a dimension). Products are
accumulated dimension block by dimension block; after each, a candidate whose partial sum plus the bound on its remaining mass (Cauchy-Schwarz on the
rest of both vectors) is below the query's k-th best lower bound is dropped and the survivors are compacted. A task keeps k rows a query over all
its packs; the last step ranks those.

Scale: work is queries times rows, as the query set asks, in ceil(queries / block) passes over the vectors; vectors are never shuffled, only k rows a
query and task are. Memory is one pack, one block and k rows a query of it. Each pass is written to the shared folder.

Cases: vectors that are null, empty or hold null or non-finite components take no part; only vectors of equal dimension are compared; sums are exact
(doubles below 2**53, else 64-bit integers, else Python integers; scores beyond 64 bits become the largest or smallest 64-bit number, and those tie);
equal scores go to the smaller id; every query row has a result of its own, repeated ids or not; a repeated id is a candidate as often as it occurs, never
for its own id; fewer than k candidates give as many rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.llm.common import fresh_path, stored, table

EXACT, LONG = float(1 << 53), float(1 << 63)
#: Rows with a component from here on are packed apart, so that they don't slow the others down.
WIDE = float(1 << 21)
#: Most bytes of a block of queries, and rows of a pack of candidates.
BLOCK_BYTES, PACK = 1 << 24, 8192
FOUND = "q_row long, query_id long, vec_id long, score long"


def merged(best: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of best and (scores, ids), by (-score, id)."""
    scores, ids = np.concatenate([best[0], scores]), np.concatenate([best[1], ids])
    if len(scores) > 4 * k:
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[near], ids[near]
    first = np.lexsort((ids, ~scores))[:k]  # ~ turns the order round without overflow
    return scores[first], ids[first]


def block_topk(q: np.ndarray, qids: np.ndarray, c: np.ndarray, cids: np.ndarray, k: int, best: list[tuple[np.ndarray, np.ndarray]], width: int = 16) -> None:
    """Merges into best[i] = (scores, ids), both sorted by (-score, id), the top k of query i among the candidates.

    q: queries x dimensions; c: dimensions x candidates (vertical); both doubles without fraction.
    """
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(len(c), 1)
    if most >= LONG:
        whole = np.array([[int(x) for x in row] for row in c], dtype=object).reshape(c.shape)
        for i, own in enumerate(qids):
            other = cids != own
            sums = np.array([int(x) for x in q[i]], dtype=object) @ whole[:, other] if len(c) else np.zeros(other.sum(), object)
            best[i] = merged(best[i], np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in sums], dtype=np.int64), cids[other], k)
        return
    dims = np.argsort(-c.var(axis=1), kind="stable")
    kind = np.float64 if most < EXACT else np.int64
    q, c = q[:, dims].astype(kind), np.ascontiguousarray(c[dims].astype(kind))
    cuts = list(range(0, len(dims), width))
    rest_q = [np.sqrt((q[:, b:].astype(float) ** 2).sum(axis=1)) for b in cuts[1:]]
    rest_c = [np.sqrt((c[b:].astype(float) ** 2).sum(axis=0)) for b in cuts[1:]]
    head = q[:, :width] @ c[:width]
    for i, own in enumerate(qids):
        alive = np.flatnonzero(cids != own)
        part = head[i, alive]
        floor = float(best[i][0][-1]) if len(best[i][0]) >= k else -np.inf
        for j, b in enumerate(cuts[1:]):
            bound = rest_q[j][i] * rest_c[j][alive]
            bound += 1e-9 * (bound + np.abs(part)) + 1e-3  # rounding of doubles
            if len(alive) > k:
                low = part - bound
                floor = max(floor, float(np.partition(low, len(low) - k)[len(low) - k]))
            keep = part + bound >= floor - 1e-9 * abs(floor) if np.isfinite(floor) else np.ones(len(part), bool)
            if not keep.all():
                alive, part = alive[keep], part[keep]
            part = part + q[i, b : b + width] @ c[b : b + width, alive]
        best[i] = merged(best[i], part.astype(np.int64), cids[alive], k)


def matrices(ids: pa.Array, vectors: pa.Array, scale: int) -> Iterator[tuple[tuple[int, bool], np.ndarray, np.ndarray]]:
    """((dimension, wide), rows, floor(scale * vector) of those rows as doubles) of a list column without nulls."""
    lens = vectors.value_lengths().to_numpy(zero_copy_only=False)
    ends, flat = np.cumsum(lens), vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    for dim in np.unique(lens):
        rows = np.flatnonzero(lens == dim)
        with np.errstate(over="ignore"):
            vals = np.nan_to_num(np.floor(flat[(ends[rows] - dim)[:, None] + np.arange(dim)] * scale))
        wide = np.abs(vals).max(axis=1) >= WIDE
        for flag in (False, True):
            if (wide == flag).any():
                yield (int(dim), flag), rows[wide == flag], vals[wide == flag]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, *, scale: int = 1024, block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of vectors for every row of queries. Both: vec_id, embedding."""
    spark = vectors.sparkSession
    sound = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    )
    asked = stored(sound(queries).withColumn("q_row", F.monotonically_increasing_id()), "queries")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    blocks = -(-size["n"] // max(1, min(block, BLOCK_BYTES // (8 * (size["dim"] or 1)))))
    path = fresh_path(spark, "top-k")

    def part_of(rows: list[pa.RecordBatch], met: dict) -> None:
        batch = pa.Table.from_batches(rows).combine_chunks()
        ids = batch.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False)
        for (dim, _), own, vals in matrices(batch.column("vec_id"), batch.column("embedding").combine_chunks(), scale):
            c = np.ascontiguousarray(vals.T)
            for (q_dim, _), (_, q_ids, q, best) in met.items():
                if q_dim == dim:
                    block_topk(q, q_ids, c, ids[own], k, best)

    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("q_row"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        q_rows, q_ids = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("q_row", "vec_id"))
        packed = {key: (q_rows[own], q_ids[own], vals) for key, own, vals in matrices(rows.column("vec_id"), rows.column("embedding").combine_chunks(), scale)}
        sent = spark.sparkContext.broadcast(packed)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            none = np.zeros(0, np.int64)
            met = {key: (r, ids, q, [(none, none)] * len(ids)) for key, (r, ids, q) in sent.value.items()}
            held, n = [], 0
            for batch in batches:
                held, n = [*held, batch], n + batch.num_rows
                if n >= PACK:
                    part_of(held, met)
                    held, n = [], 0
            if n:
                part_of(held, met)
            for r, ids, _, best in met.values():
                sizes = [len(x[0]) for x in best]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(r, sizes)), pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([x[1] for x in best])), pa.array(np.concatenate([x[0] for x in best]))], ["q_row", "query_id", "vec_id", "score"])

        sound(vectors).mapInArrow(search, FOUND).write.parquet(f"{path}/block={b}")
        sent.unpersist()
    found = spark.read.schema(FOUND).parquet(path) if size["n"] else spark.createDataFrame([], FOUND)
    rank = F.row_number().over(W.partitionBy("q_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
