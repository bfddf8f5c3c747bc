"""Operator 11, ranked lexical search: an inverted index cut into shards, and MaxScore in every shard.

A document's score for a query sums w * tf-part over the query's terms, once each, in integers: w = floor(1000 ln((2N+2)/(2df+1))),
tf-part = (10^9 tf) div (1000 tf + 8 m), m = 10 + (90 n N) div L.

1. ``index`` cuts the documents into shards of bounded size and stores one row a shard: ids, lengths, and the postings of the wanted terms (document, tf), by term.
   Terms no query has are counted in the lengths and left out.
2. Document counts, lengths and df come from the shards by one aggregate over (term, postings) pairs, combined map-side.
3. ``best_in`` ranks a shard's documents for every query, block by block of documents. A term's upper bound is w times the largest tf-part in the shard.
   Terms in ascending order of bounds are non-essential as long as their bounds sum to less than the score to beat; documents found in no essential list
   are never looked at. Essential lists are added up; then non-essential postings are probed, largest bound first, and only for documents that
   can still reach the score to beat. That score rises with every block.
4. A sixteenth of the shards is searched first. The k-th best scores found there are the scores to beat for the other shards, so these emit next to nothing and
   what is merged doesn't grow with shards x queries x k.
5. Spark merges: row numbers a query, limited to k in every task before the exchange.

Queries go in blocks of at most ``block_terms`` distinct terms (the vocabulary that tasks hold), one index and one search a block; so no table of terms grows
with the data, and the documents are read once a block.

Cases: null, empty or wordless documents count nowhere; very long texts are split whole; a wordless query returns nothing; a query row is a query, whatever its
id; rows with equal ids are ranked each by its own text, those without an id behind others of equal score; ties go to the smaller id, then by place; an empty table on either
side gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.llm.common import by_bytes, stored, table, text_batches, words

#: Bytes that are no part of a word become blanks; texts are lower-cased as bytes, so A-Z only.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Documents and bytes of text of a shard at most (a longer document is a shard); documents of a block.
SHARD_DOCS, SHARD_BYTES, BLOCK_DOCS = 8192, 16 << 20, 1024
#: One in so many shards is searched first.
FIRST = 16
INDEX = "shard long, words long, ids array<long>, lengths binary, terms array<int>, df array<int>, docs binary, tf binary"


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpacked(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """One row a shard, as INDEX says. docs: id (long), text."""
    sent = docs.sparkSession.sparkContext.broadcast({w.encode(): i for i, w in enumerate(vocabulary)})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, size, v = TaskContext.get().partitionId(), 0, 0, len(sent.value)
        ids: list[int | None] = []
        lengths: list[int] = []
        met: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            nonlocal ids, lengths, met, size, made
            every = np.concatenate([m.astype(np.int64) * len(ids) + d for d, m in enumerate(met)])
            keys, tf = np.unique(every, return_counts=True)  # by term, then by document
            terms, df = np.unique(keys // len(ids), return_counts=True)
            row = {"shard": [(part << 32) + made], "words": [sum(lengths)], "ids": [ids], "lengths": [packed(np.array(lengths, np.int32))], "terms": [terms.astype(np.int32)], "df": [df.astype(np.int32)], "docs": [packed((keys % len(ids)).astype(np.int32))], "tf": [packed(tf.astype(np.int32))]}
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            ids, lengths, met, size, made = [], [], [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row.values(), kinds)], list(row))

        class Numbers(dict):
            def __missing__(self, word: bytes) -> int:
                return v

        number = Numbers(sent.value).__getitem__
        for batch in by_bytes(batches, "text"):
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                own = (text or b"").lower().translate(WORD_BYTES).split()
                if own:
                    found = np.fromiter(map(number, own), np.int32, len(own))
                    ids.append(key)
                    lengths.append(len(own))
                    met.append(found[found < v])
                    size += len(text)
                if len(ids) >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield shard()
        if ids:
            yield shard()

    return docs.mapInArrow(build, INDEX)


def kth_best(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def best_in(starts: np.ndarray, docs: np.ndarray, gain: np.ndarray, bound: np.ndarray, n_docs: int, k: int, floor: int, probes: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a shard that may be among a query's k best: those with the k best scores above 0, and all ties with the last.

    List t of the query is docs[starts[t, 0]:starts[t, 1]] with what each gains (w * tf-part); bound[t] is the largest gain. floor: the score to beat or tie.
    probes: counts postings looked at, for tests.
    """
    order = np.argsort(bound, kind="stable")
    starts, upto = starts[order], np.cumsum(bound[order])
    kept, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    beat = max(floor, 1)
    for lo in range(0, n_docs, BLOCK_DOCS):
        hi = min(lo + BLOCK_DOCS, n_docs)
        split = int(np.searchsorted(upto, beat, side="left"))  # terms before it sum to less than beat
        if split == len(order):
            break  # no document can reach it any more
        total, seen = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, bool)
        for a, b in starts[split:]:
            a, b = a + np.searchsorted(docs[a:b], lo), a + np.searchsorted(docs[a:b], hi)
            total[docs[a:b] - lo] += gain[a:b]
            seen[docs[a:b] - lo] = True
            if probes is not None:
                probes.append(int(b - a))
        rest = np.flatnonzero(seen)
        for t in range(split - 1, -1, -1):
            rest = rest[total[rest] + upto[t] >= beat]
            if not len(rest):
                break
            a, b = starts[t]
            at = a + np.searchsorted(docs[a:b], rest + lo)
            hit = at < b
            hit[hit] = docs[at[hit]] == rest[hit] + lo
            total[rest[hit]] += gain[at[hit]]
            if probes is not None:
                probes.append(len(rest))
        rest = rest[total[rest] >= beat]
        kept, scores = np.concatenate([kept, rest + lo]), np.concatenate([scores, total[rest]])
        beat = max(beat, kth_best(scores, k))
        live = scores >= beat
        kept, scores = kept[live], scores[live]
    return kept, scores


def search(shards: DataFrame, asked: list[tuple[int, np.ndarray]], weights: np.ndarray, n: int, total: int, k: int, floors: dict[int, tuple[int, int | None]]) -> DataFrame:
    """(query, doc, shard, at, score): from every shard the documents that may be among a query's k best, k at most. floors: a query's k-th best score and id so far."""
    sent = shards.sparkSession.sparkContext.broadcast((asked, weights, floors))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights, floors = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths = row["ids"], unpacked(row["lengths"], np.int32).astype(np.int64)
                terms, df = np.array(row["terms"], np.int64), np.array(row["df"], np.int64)
                docs, tf = unpacked(row["docs"], np.int32), unpacked(row["tf"], np.int32).astype(np.int64)
                m = np.array([10 + (90 * x * n) // total for x in lengths.tolist()], np.int64)
                ends = np.concatenate([[0], np.cumsum(df)])
                gain = np.repeat(weights[terms], df) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
                bound = np.maximum.reduceat(gain, ends[:-1]) if len(terms) else gain
                nobody = np.iinfo(np.int64).max
                order = np.array([nobody if x is None else x for x in ids], np.int64)
                out: list[tuple] = []
                for query, own in asked:
                    at = np.searchsorted(terms, own[np.isin(own, terms, assume_unique=True)])
                    if len(at):
                        floor, behind = floors.get(query, (0, None))
                        found, scores = best_in(np.stack([ends[at], ends[at + 1]], axis=1), docs, gain, bound[at], len(ids), k, floor)
                        behind = nobody if behind is None else behind
                        live = (scores > floor) | (order[found] <= behind)  # equal scores are many where texts are copies
                        first = np.lexsort((found, order[found], -scores))
                        first = first[live[first]][:k]
                        out += [(query, ids[d], row["shard"], d, s) for d, s in zip(found[first].tolist(), scores[first].tolist())]
                cols = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()])], ["query", "doc", "shard", "at", "score"])

    return shards.select("shard", "ids", "lengths", "terms", "df", "docs", "tf").mapInArrow(best, "query long, doc long, shard long, at int, score long")


def top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), F.col("doc").asc_nulls_last(), "shard", "at")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def blocks(queries: DataFrame, block_terms: int, block_queries: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Numbered queries with their terms, in lists of at most so many distinct terms and queries (a query of more terms is a list of its own)."""
    own: list[tuple[int, list[str]]] = []
    met: set[str] = set()
    for row in queries.toLocalIterator():
        if own and (len(met | set(row["terms"])) > block_terms or len(own) >= block_queries):
            yield own
            own, met = [], set()
        own.append((row["query"], row["terms"]))
        met |= set(row["terms"])
    if own:
        yield own


def ranked_search(docs: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text_col: str = "text", block_terms: int = 200_000, block_queries: int = 10_000) -> DataFrame:
    """(query id, rank, id, score): the k best documents above 0 of every row of queries."""
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = stored(queries.select(F.monotonically_increasing_id().alias("query"), F.col(query_col).alias("name"), F.array_distinct(words(F.col(query_text_col))).alias("terms")), "queries")
    out = spark.createDataFrame([], "query long, rank int, doc long, score long")
    for own in blocks(asked.filter(F.size("terms") > 0).select("query", "terms"), block_terms, block_queries):
        vocabulary = sorted({w for _, ws in own for w in ws})
        number = {w: i for i, w in enumerate(vocabulary)}
        shards = stored(index(docs, vocabulary), "shards")
        n, total = shards.agg(F.sum(F.size("ids")), F.sum("words")).first()
        if not n:
            break
        held = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df"))
        weights = np.zeros(len(vocabulary), np.int64)
        for t, w in held.select("terms", F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).alias("w")).toLocalIterator():
            weights[t] = w
        lists = [(q, np.array(sorted(number[w] for w in ws), np.int64)) for q, ws in own]
        first = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
        begun = stored(top(search(shards.filter(first), lists, weights, n, total, k, {}), k), "first-found")
        floors = {r["query"]: (r["score"], r["doc"]) for r in begun.filter(F.col("rank") == k).select("query", "score", "doc").toLocalIterator()}
        rest = search(shards.filter(~first), lists, weights, n, total, k, floors)
        found = stored(top(begun.drop("rank").unionByName(rest), k), "found")
        out = out.unionByName(found.select("query", F.col("rank").cast("int"), "doc", "score"))
    return asked.select("query", "name").join(out, "query").select(F.col("name").alias(query_col), "rank", F.col("doc").alias(id_col), "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
v AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
c AS (SELECT i.item_id, p.doc_id, CAST(sum(v.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + (90 * p.n * n_docs) // n_terms)))) AS BIGINT) AS score FROM i JOIN p USING (term) JOIN v USING (term), s GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
