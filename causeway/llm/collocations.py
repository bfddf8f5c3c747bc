"""Operator 12, phrase collocation mining: count tries per shard, merged by ranges of phrases; trie walks give left parts, suffix links right parts.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks, and pieces into words at blanks and tabs. Everything is per language. Candidates are
phrases of 2 to ``max_words`` words met at least ``min_count`` times; a cut after k words scores floor(1000 a n / (l r)), the lowest cut counts.

1. ``encode`` cuts the texts of a language into shards of bounded size and stores each with its sorted words and its text as word numbers, compressed.
   So texts are split once.
2. ``levels`` counts a shard's phrases level by level: a node is (its parent, a word), numbered by sorting, so nodes come out in the order of a sorted trie. A
   level's nodes are only opened where the level above is frequent over all shards (a phrase can't be more frequent than its parts). Which
   are, is found for words, pairs and triples by counting hashes: sorted, cut by ranges, sent as differences, about three bytes each. What is
   frequent goes to the tasks as a Bloom filter; a false positive costs a count and changes none.
3. ``trie`` then counts each shard's phrases down to ``max_words``; ``merged`` serialises every trie sorted, cut at the borders of ranges of (language, phrase),
   and merges a range at a time. Borders are drawn from some tries, so a range begins inside a frequent first word where that has many phrases.
4. ``linked`` walks the merged trie level by level: a node's left parts are its parent's and its parent itself; its right parts are found over its suffix link
   (the phrase without its first word) and that node's own. Both are joins of frequent phrases.
5. A candidate inside a longer one as frequent as itself is dropped. One word more is enough to look at: what holds it in a still longer phrase holds it there too.

Scale: hashes of phrases shuffle only where their parts are frequent, phrases themselves only where their first three levels are. A filter has 16 bits a phrase up to ``max_bits``; beyond, it lets more
phrases through to be counted and the result stays exact. Scores are computed in decimals of 38 digits.

Cases: a null text is empty, a null language is ``und`` (one language with those so named); very long texts are split whole, one at a time; ties go
to the smaller k and, between phrases, to the larger count, then to the smaller phrase in byte order; repeated rows count as often as they occur; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.llm.common import by_bytes, stored, table, text_batches
from causeway.llm.lexical import packed, unpacked
from causeway.llm.line_dedup import filter_shape, has, probes, put

#: Ends of pieces all become the first of them, which no word can hold.
PIECES = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
#: Bytes of text of a shard, and of all open shards of a task together.
SHARD_BYTES, OPEN_BYTES = 10 << 20, 24 << 20
SHARDS = "shard long, lang string, size long, words array<string>, counts array<long>, text binary"
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the hashes that are counted, levels of which they are, hashes a task merges at a time, words a range at least.
BITS, HASHED, MERGED, RANGE_WORDS = 44, 3, 1 << 21, 20_000_000
#: Shards, and nodes of each at most, from which the borders of ranges are drawn; they decide how even ranges are, nothing else.
SAMPLED, NODES = 24, 2000
Filter = tuple[np.ndarray, int]


def encode(texts: DataFrame) -> DataFrame:
    """Shards as SHARDS says: a number, sorted words, their counts, and the text as numbers from 1, 0 between pieces. texts: lang, text."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = count(TaskContext.get().partitionId() << 32)

        class Shard:
            def __init__(self) -> None:
                self.numbers: dict[bytes, int] = defaultdict(count(1).__next__)
                self.numbers[b"."] = 0
                self.parts: list[np.ndarray] = []
                self.size = 0

        def row(lang: str, shard: Shard) -> pa.RecordBatch:
            words = sorted(w for w in shard.numbers if w != b".")
            place = np.zeros(len(words) + 1, np.int32)
            place[[shard.numbers[w] for w in words]] = np.arange(1, len(words) + 1)
            text = place[np.concatenate(shard.parts)]
            counts = np.bincount(text, minlength=len(words) + 1)[1:]
            cols = [[next(made)], [lang], [int(counts.sum())], [[w.decode() for w in words]], [counts], [packed(text)]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()))], ["shard", "lang", "size", "words", "counts", "text"])

        open_: dict[str, Shard] = defaultdict(Shard)
        for batch in by_bytes(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                shard = open_[lang]
                tokens = text.lower().translate(PIECES).replace(b".", b" . ").split()
                tokens.append(b".")
                shard.parts.append(np.fromiter(map(shard.numbers.__getitem__, tokens), np.int32, len(tokens)))
                shard.size += len(text) + 1
                if shard.size >= SHARD_BYTES:
                    yield row(lang, open_.pop(lang))
            if sum(s.size for s in open_.values()) >= OPEN_BYTES:
                largest = max(open_, key=lambda x: open_[x].size)
                yield row(largest, open_.pop(largest))
        for lang, shard in open_.items():
            yield row(lang, shard)

    return texts.mapInArrow(build, SHARDS)


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang)
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], dtype=np.uint64)


def longer_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all words but the last, and of the last."""
    x = a * MIX ^ (b + (a >> np.uint64(29)))
    return (x ^ (x >> np.uint64(32))) * MIX


def levels(lang: str, words: pa.StringArray, text: np.ndarray, filters: list[Filter], upto: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(parent, last word, hash, count) of the nodes of a shard's trie, level by level and sorted; parents are numbers of the level above, words count from 1.

    Nodes that the filter of their level doesn't hold are left out. A phrase is a node only if both phrases of one word less in it are.
    """
    text, size = text.astype(np.int64), len(words) + 1
    one = np.concatenate([np.zeros(1, np.uint64), word_hashes(lang, words.to_pylist())])
    parent, last, hashes, counts = np.zeros(size - 1, np.int64), np.arange(1, size), one[1:], np.bincount(text, minlength=size)[1:]
    at = text - 1  # the node of the phrase that begins at a place, -1: none
    for depth in range(1, upto + 1):
        if depth > 1:
            begins = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
            nodes, which = np.unique(at[begins] * size + text[begins + depth - 1], return_inverse=True)
            parent, last, counts = nodes // size, nodes % size, np.bincount(which, minlength=len(nodes))
            hashes = longer_hashes(hashes[parent], one[last])
            at = np.full(len(text), -1, np.int64)
            at[begins] = which
            del begins, nodes, which
        if depth <= len(filters):
            kept = inside(filters[depth - 1], hashes)
            parent, last, hashes, counts = parent[kept], last[kept], hashes[kept], counts[kept]
            number = np.append(np.where(kept, np.cumsum(kept) - 1, -1), -1)
            at = number[at]
        yield parent, last, hashes, counts


def hash_counts(shards: DataFrame, filters: list[Filter], min_count: int, ranges: int) -> DataFrame:
    """(h): the hashes, in blobs, of phrases one word longer than the filters know that occur min_count times at least.

    A shard's hashes go out sorted and cut by range, as differences; a range is merged at a time. Hashes fall evenly, so no range is hot.
    """
    sent = shards.sparkSession.sparkContext.broadcast(filters)
    edges = np.array([(i << BITS) // ranges for i in range(1, ranges)], np.uint64)

    def count_up(h: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, which = np.unique(np.concatenate(h), return_inverse=True)
        return keys, np.minimum(np.bincount(which, np.concatenate(n), len(keys)), min_count).astype(np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, text in zip(*(batch.column(c) for c in ("lang", "words", "text"))):
                *_, (_, _, hashes, counts) = levels(lang.as_py(), words.values, unpacked(text.as_py(), np.int32), sent.value, len(sent.value) + 1)
                keys, n = count_up([hashes >> np.uint64(64 - BITS)], [counts])
                at = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                own = np.flatnonzero(np.diff(at))
                steps = [np.diff(keys[at[r] : at[r + 1]], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T for r in own]  # bytes of one weight side by side
                cols = [pa.array(own, pa.int32()), pa.array([packed(x) for x in steps], pa.binary()), pa.array([packed(n[at[r] : at[r + 1]].astype(np.uint32)) for r in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "keys", "n"])
                del hashes, counts, keys, n, steps
                pa.default_memory_pool().release_unused()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, n, waiting = -1, [], [], 0

        def frequent() -> pa.RecordBatch:
            whole, total = count_up(keys, n)
            return pa.RecordBatch.from_arrays([pa.array([whole[total >= min_count].tobytes()], pa.binary())], ["h"])

        for batch in batches:
            for part, k, c in zip(*(batch.column(x).to_pylist() for x in ("part", "keys", "n"))):
                if part != now and keys:
                    yield frequent()
                    keys, n, waiting = [], [], 0
                now = part
                keys.append(np.cumsum(np.ascontiguousarray(unpacked(k, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()))
                n.append(unpacked(c, np.uint32).astype(np.int64))
                waiting += len(keys[-1])
                if waiting > MERGED:
                    first, total = count_up(keys, n)
                    keys, n, waiting = [first], [total], 0
        if keys:
            yield frequent()

    parts = shards.select("lang", "words", "text").mapInArrow(cut, "part int, keys binary, n binary")
    return parts.repartition(ranges, "part").sortWithinPartitions("part").mapInArrow(merge, "h binary")


def frequent_filter(hashes: DataFrame, max_bits: int) -> Filter:
    """A Bloom filter of hashes in blobs, and its probes a phrase."""
    bits, k = filter_shape(hashes.agg(F.sum(F.octet_length("h"))).first()[0] // 8 if not hashes.isEmpty() else 0, 16, max_bits)
    bitmap = np.zeros(bits // 8, np.uint8)
    for (h,) in hashes.toLocalIterator():
        put(bitmap, probes(np.frombuffer(h, np.uint64) * MIX, bits, k))
    return bitmap, k


def inside(known: Filter, hashes: np.ndarray) -> np.ndarray:
    return has(known[0], probes((hashes >> np.uint64(64 - BITS)) * MIX, known[0].size * 8, known[1])) if len(hashes) else np.zeros(0, bool)


def trie(lang: str, words: pa.StringArray, text: np.ndarray, filters: list[Filter], max_words: int) -> tuple[pa.Array, np.ndarray]:
    """(phrases, counts): all nodes of a shard's trie that the filters let through, sorted."""
    strings = pa.concat_arrays([pa.array([""], pa.string()), words.cast(pa.string())])
    found, numbers = [strings.slice(0, 0)], [np.zeros(0, np.int64)]
    for parent, last, _, counts in levels(lang, words, text, filters, max_words):
        ends = strings.take(pa.array(last))
        found.append(pc.binary_join_element_wise(found[-1].take(pa.array(parent)), ends, " ") if len(found) > 1 else ends)
        numbers.append(counts)
    phrases = pa.concat_arrays(found)
    order = pc.sort_indices(phrases)
    return phrases.take(order), np.concatenate(numbers)[order.to_numpy()]


def borders(shards: DataFrame, filters: list[Filter], max_words: int, ranges: int) -> list[tuple[str, str]]:
    """(language, phrase) where ranges of about equal size begin, by every so manieth node of SAMPLED tries."""
    sent = shards.sparkSession.sparkContext.broadcast(filters)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, text in zip(*(batch.column(c) for c in ("lang", "words", "text"))):
                phrases, _ = trie(lang.as_py(), words.values, unpacked(text.as_py(), np.int32), sent.value, max_words)
                step = -(-len(phrases) // NODES) or 1
                own = phrases.take(pa.array(np.arange(0, len(phrases), step)))
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(own)), own, pa.repeat(pa.scalar(step, pa.int64()), len(own))], ["lang", "phrase", "n"])

    ids = [r[0] for r in shards.select("shard").orderBy(F.xxhash64("shard")).limit(SAMPLED).collect()]
    taken = shards.filter(F.col("shard").isin(ids)).select("lang", "words", "text").mapInArrow(some, "lang string, phrase string, n long")
    rows = sorted((r["lang"], r["phrase"], r["n"]) for r in taken.collect())
    upto = np.cumsum([n for *_, n in rows])
    at = np.searchsorted(upto, np.arange(1, ranges) * (upto[-1] / ranges)) if rows else []
    return sorted({rows[i][:2] for i in at})


def merged(shards: DataFrame, filters: list[Filter], max_words: int, min_count: int, ranges: int) -> DataFrame:
    """(lang, phrase, n) of the phrases met min_count times over all shards: sorted tries, cut at the borders, merged range by range."""
    sent = shards.sparkSession.sparkContext.broadcast((filters, borders(shards, filters, max_words, ranges)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, ends = sent.value
        for batch in batches:
            for lang, words, text in zip(*(batch.column(c) for c in ("lang", "words", "text"))):
                name = lang.as_py()
                phrases, counts = trie(name, words.values, unpacked(text.as_py(), np.int32), filters, max_words)
                first = bisect_left(ends, (name,))
                inner = [bisect_left(range(len(phrases)), p, key=lambda i: phrases[i].as_py()) for x, p in ends if x == name]  # noqa: B023
                at = [0, *inner, len(phrases)]
                own = [i for i in range(len(at) - 1) if at[i] < at[i + 1]]
                bytes_ = [zstandard.ZstdCompressor(level=1).compress("\n".join(phrases[at[i] : at[i + 1]].to_pylist()).encode()) for i in own]
                cols = [pa.array([first + i for i in own], pa.int32()), pa.repeat(lang, len(own)), pa.array(bytes_, pa.binary()), pa.array([packed(counts[at[i] : at[i + 1]].astype(np.int64)) for i in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "lang", "phrases", "n"])
                pa.default_memory_pool().release_unused()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting = None, []

        def summed() -> pa.Table:
            return pa.concat_tables(waiting).group_by("phrase").aggregate([("n", "sum")]).rename_columns(["phrase", "n"])

        def frequent() -> Iterator[pa.RecordBatch]:
            whole = summed()
            for own in whole.filter(pc.greater_equal(whole["n"], min_count)).combine_chunks().to_batches(max_chunksize=1 << 16):
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(now[1]), own.num_rows), own["phrase"], own["n"]], ["lang", "phrase", "n"])

        for batch in batches:
            for part, lang, phrases, n in zip(*(batch.column(x).to_pylist() for x in ("part", "lang", "phrases", "n"))):
                if waiting and (part, lang) != now:
                    yield from frequent()
                    waiting = []
                now = part, lang
                waiting.append(pa.table({"phrase": pa.array(zstandard.ZstdDecompressor().decompress(phrases).decode().split("\n"), pa.string()), "n": pa.array(unpacked(n, np.int64))}))
                if len(waiting) > 1 and sum(t.num_rows for t in waiting) > MERGED:
                    waiting = [summed()]
        if waiting:
            yield from frequent()

    parts = shards.select("lang", "words", "text").mapInArrow(cut, "part int, lang string, phrases binary, n binary")
    whole = parts.repartition(ranges, "part").sortWithinPartitions("part", "lang").mapInArrow(merge, "lang string, phrase string, n long")
    return stored(whole, "phrases")


def linked(phrases: DataFrame, max_words: int) -> list[DataFrame]:
    """By number of words from 1: (lang, phrase, n, parent, suffix, lefts, rights); lefts[k - 1] and rights[k - 1] count the parts of a cut after k words."""
    width = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1
    none = F.array().cast("array<long>")
    out = [phrases.filter(width == 1).select("*", F.lit("").alias("parent"), F.lit("").alias("suffix"), none.alias("lefts"), none.alias("rights"))]
    for m in range(2, max_words + 1):
        below = out[-1].select("lang", F.col("phrase").alias("p"), F.col("n").alias("own"), "lefts", "rights")
        nodes = phrases.filter(width == m).withColumns({"parent": F.substring_index("phrase", " ", m - 1), "suffix": F.substring_index("phrase", " ", 1 - m)})
        walk = below.select("lang", F.col("p").alias("parent"), F.concat("lefts", F.array("own")).alias("lefts"))
        link = below.select("lang", F.col("p").alias("suffix"), F.concat(F.array("own"), "rights").alias("rights"))
        out.append(stored(nodes.join(walk, ["lang", "parent"]).join(link, ["lang", "suffix"]).select("lang", "phrase", "n", "parent", "suffix", "lefts", "rights"), f"level-{m}"))
    return out


def cut_score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (l r)), exact beyond 64 bits."""
    return F.expr(f"(1000 * CAST({a} AS DECIMAL(17, 0)) * CAST({n} AS DECIMAL(17, 0))) div (CAST({left} AS DECIMAL(18, 0)) * CAST({right} AS DECIMAL(18, 0)))")


def collocations(docs: DataFrame, *, min_count: int = 100, max_words: int = 5, first: int = 2000, drop_percent: int = 100, text_col: str = "text", lang_col: str = "lang", max_bits: int = 1 << 30) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first candidates by score. drop_percent: the share of a candidate's count at which a longer one displaces it."""
    text_batches(docs.sparkSession)
    shards = stored(encode(docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))), "shards")
    totals = shards.groupBy("lang").agg(F.sum("size").alias("total"))
    total = shards.agg(F.sum("size")).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // RANGE_WORDS)
    filters: list[Filter] = []
    for depth in range(1, min(max_words, HASHED) + 1):
        filters.append(frequent_filter(stored(hash_counts(shards, filters, min_count, ranges), f"frequent-{depth}"), max_bits))
    steps = linked(merged(shards, filters, max_words, min_count, ranges), max_words)
    nodes = reduce(DataFrame.unionByName, steps[1:])
    within = nodes.select("lang", F.explode(F.array("parent", "suffix")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = nodes.join(within, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < drop_percent * F.col("n")))
    rows = kept.join(totals, "lang").select("lang", "phrase", F.col("n").alias("a"), F.col("total").alias("n"), F.explode(F.arrays_zip(F.sequence(F.lit(1), F.size("lefts")).alias("k"), F.col("lefts").alias("l"), F.col("rights").alias("r"))).alias("cut"))
    best = rows.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(cut_score("a", "n", "cut.l", "cut.r").alias("score"), "cut.k", "cut.l", "cut.r")).alias("x"))
    best = best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, m, array_to_string(ws, ' ') AS phrase, ws, count(*) AS f FROM (
  SELECT lang, m, w[p:p + m - 1] AS ws FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)) GROUP BY lang, m, ws),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE m > 1 AND f >= 100),
q AS (SELECT lang, phrase, f, m, ws, unnest(range(1, m)) AS k FROM c),
s AS (SELECT q.lang, q.phrase, q.f, q.m, q.k, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * q.f * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM q JOIN n USING (lang) JOIN g x ON x.lang = q.lang AND x.ws = q.ws[1:q.k] JOIN g y ON y.lang = q.lang AND y.ws = q.ws[q.k + 1:q.m]),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase, m ORDER BY score, k) AS nth FROM s) WHERE nth = 1),
d AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c x ON x.lang = c.lang AND x.m > c.m AND 100 * x.f >= 100 * c.f AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank, phrase, f AS a, l, r, n, score FROM b ANTI JOIN d USING (lang, phrase)) WHERE rank <= 2000
"""
