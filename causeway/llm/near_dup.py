"""Operator 6, near-duplicate classes: BagMinHash signatures, banding, verified multiset overlap.

Documents are multisets of five-word shingles; two are linked if their multiset (weighted) Jaccard similarity is at least ``threshold``; classes are the
connected components of the links.

1. Signatures (BagMinHash): each shingle is a Poisson process over time and weight. The weight axis is cut into the dyadic intervals [0,1), [1,2),
   [2,4), ...; each interval has a process of its own rate, whose points fall on registers; a point counts if its level is below the shingle's
   count. A register keeps its earliest point. Processes stop once they are later than the latest register, so the cost is about
   shingles + registers * log(registers). All documents of a batch run together in numpy.
2. Equal multisets are one node from here on. ``bands`` bands of ``rows`` registers give buckets; at similarity 0.8, 24 bands of 5 miss a pair
   with probability 7e-5.
3. In a bucket every node is verified against its leader, the node with the largest buckets (a star: no more pairs than members), by exact multiset
   overlap of the texts. Rows are dealt by leader and part, sorted so that the leader's text is ahead of its members', and streamed: its bag is made once a part.
4. Links that a star can't see join different components through a bucket: such pairs are verified too, unless one of three exact bounds excludes them: the
   triangle inequality of the Jaccard distance through the leader, or the overlap that sizes ask for against the shingles that a node shares with
   any other node, or the shingles that bitmaps show to be missing. Pairs within a component can't change classes and are never made.

Scale: texts are scanned once for signatures and once more for candidates; buckets are (hash, node) rows, combined map-side, so a bucket with a third of all
documents is no group in any task; a leader's members are dealt to parts of about ``MEMBERS``; skewed joins are left to AQE. Python works on slices of about
a megabyte of text, so long texts cost no more memory than many short ones. Components shrink by large-star/small-star rounds,
each written to the shared folder.

Cases: texts without words (null, empty, punctuation) are classes of their own; one to four words are one shingle; very long texts are read whole, one a slice; rows of equal text are in one class whatever
their ids; a class is named by its smallest id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import by_bytes, small, stored, table, text_batches

U = np.uint64
SPAN = 1 << 20
#: Longs of a bitmap, 64 shingles each.
LONGS = 16
#: About as many members are compared with one copy of their leader's text.
MEMBERS = 256


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64 arrays."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64)
BYTE = mix(FOLDED + U(0x5851F42D4C957F2D))
POWER = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word of the texts data[offsets[i]:offsets[i + 1]], in order; worked in spans of about a megabyte cut at gaps."""
    docs, hashes, a, end = [np.zeros(0, np.int64)], [np.zeros(0, U)], int(offsets[0]), int(offsets[-1])
    while a < end:
        b = min(a + SPAN, end)
        while b < end and IS_WORD[data[b - 1]] and IS_WORD[data[b]]:
            b += 1
        part = data[a:b]
        word = IS_WORD[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = offsets[(offsets > a) & (offsets < b)] - a
        first[inner] = word[inner]
        at = np.flatnonzero(first)
        if len(at):
            where = np.flatnonzero(word)
            starts = np.searchsorted(where, at)
            lens = np.diff(np.append(starts, len(where)))
            place = np.arange(len(where)) - np.repeat(starts, lens)
            hashes.append(mix(np.add.reduceat(BYTE[part[where]] * POWER[place & 0xFFF], starts) + lens.astype(U)))
            docs.append(np.searchsorted(offsets, at + a, side="right") - 1)
        a = b
    return np.concatenate(docs), np.concatenate(hashes)


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes of an Arrow string column without nulls."""
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return word_hashes(np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8), offsets)


def shingle_bags(docs: np.ndarray, hashes: np.ndarray, n_docs: int, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count) sorted by text and shingle; a text of fewer than ``size`` words has one shingle, of all of them."""
    count = np.bincount(docs, minlength=n_docs)
    start = np.cumsum(count) - count
    full = max(len(hashes) - size + 1, 0)
    run = np.zeros(full, U)
    for j in range(size):
        run = mix(run * U(3) + hashes[j : j + full])
    ok = docs[:full] == docs[size - 1 : size - 1 + full] if full else np.zeros(0, bool)
    d, h = [docs[:full][ok]], [run[ok]]
    for n in range(1, size):
        own = np.flatnonzero(count == n)
        if len(own):
            x = np.full(len(own), n, U)
            for j in range(n):
                x = mix(x * U(3) + hashes[start[own] + j])
            d.append(own)
            h.append(x)
    d, h = np.concatenate(d), np.concatenate(h)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.append(at, len(d)))


def bag_minhash(docs: np.ndarray, shingles: np.ndarray, counts: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """n_docs x registers times of the earliest points; texts without shingles keep inf."""
    doc, seed, low, rate, top = [docs], [mix(shingles)], [np.zeros(len(docs))], [np.ones(len(docs))], [counts.astype(float)]
    lower = 1
    more = counts > lower
    while more.any():  # the dyadic intervals [1,2), [2,4), ...
        doc.append(docs[more])
        seed.append(mix(shingles[more] + U(lower)))
        low.append(np.full(more.sum(), float(lower)))
        rate.append(low[-1])
        top.append(counts[more].astype(float))
        lower *= 2
        more = counts > lower
    doc, seed, low, rate, top = map(np.concatenate, (doc, seed, low, rate, top))
    out = np.full(n_docs * registers, np.inf)
    time, i = np.zeros(len(doc)), 0
    unit = lambda x: ((x >> U(11)).astype(float) + 0.5) / (1 << 53)
    while len(doc):
        point = mix(seed + U((2 * i + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1))
        time = time - np.log(unit(point)) / rate
        where = mix(point + U(0x632BE59BD9B4E019))
        near = time < out.reshape(n_docs, registers).max(axis=1)[doc]
        hit = near & ((rate < 1.5) | (low + rate * unit(mix(where)) < top))
        np.minimum.at(out, doc[hit] * registers + (where[hit] % U(registers)).astype(np.int64), time[hit])
        near &= time < out.reshape(n_docs, registers).max(axis=1)[doc]
        doc, seed, low, rate, top, time, i = doc[near], seed[near], low[near], rate[near], top[near], time[near], i + 1
    return out.reshape(n_docs, registers)


def overlap_with(lead: tuple[np.ndarray, np.ndarray], d: np.ndarray, h: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Multiset Jaccard similarity of one bag (shingles ascending, counts) with each of n bags (d: bag number, h: shingle, c: count)."""
    every = np.bincount(d, weights=c, minlength=n) + lead[1].sum()
    if not len(lead[0]):
        return np.zeros(n)
    at = np.minimum(np.searchsorted(lead[0], h), len(lead[0]) - 1)
    same = lead[0][at] == h
    both = np.bincount(d[same], weights=np.minimum(c[same], lead[1][at[same]]), minlength=n)
    return both / np.maximum(every - both, 1)


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(id, th, m1, m2, n, bands) of every text with a word. docs: id, th, text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            n = batch.num_rows
            d, h, c = shingle_bags(*text_words(batch.column("text")), n, size)
            times = bag_minhash(d, h, c, n, bands * rows).view(U).reshape(n, bands, rows)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=U), (n, bands)).copy()
            for j in range(rows):
                key = mix(key * U(3) + times[:, :, j])
            m1, m2 = np.zeros(n, U), np.zeros(n, U)
            np.add.at(m1, d, mix(h + c.astype(U) * U(0xA0761D6478BD642F)))
            np.add.at(m2, d, mix(h ^ mix(c.astype(U) + U(0xE7037ED1A0B428DB))))
            count = np.bincount(d, weights=c, minlength=n).astype(np.int64)
            own = pa.array(count > 0)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(key.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(m1.view(np.int64)), pa.array(m2.view(np.int64)), pa.array(count), listed], ["id", "th", "m1", "m2", "n", "bands"]).filter(own)

    return docs.mapInArrow(sign, "id long, th long, m1 long, m2 long, n long, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): one label a component, for every node of edges (a, b). Large-star and small-star rounds until only stars are left."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")

    def stars() -> bool:
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty()

    while not stars():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        e = stored(small_.filter("u > v").distinct(), "edges")
    joined = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return joined.unionByName(joined.select(F.col("comp").alias("node"), "comp").distinct())


def own_mass(texts: DataFrame, size: int) -> DataFrame:
    """(node, own): how many of a node's shingles, with their counts, no other node of texts (node, text) has. Nodes without any are left out."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            d, h, c = shingle_bags(*text_words(batch.column("text")), batch.num_rows, size)
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(d)), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["node", "h", "c"])

    rows = texts.mapInArrow(spread, "node long, h long, c long")
    once = rows.groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("last"), F.sum("c").alias("c")).filter("node = last")
    return once.groupBy("node").agg(F.sum("c").alias("own"))


def bitmaps(texts: DataFrame, size: int) -> DataFrame:
    """(node, b0, b1, ...): the bits that a node's shingles (each occurrence one of its own) set. texts: node, text.

    A bit set in x and not in y is a shingle of x that y lacks, so x and y share at most n(x) - |x & ~y| shingles.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            d, h, c = shingle_bags(*text_words(batch.column("text")), batch.num_rows, size)
            nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            bit = (mix(np.repeat(h, c) + nth.astype(U) * U(0xD6E8FEB86659FD93)) % U(64 * LONGS)).astype(np.int64)
            drawn = np.zeros((batch.num_rows, 64 * LONGS), np.uint8)
            drawn[np.repeat(d, c), bit] = 1
            longs = np.packbits(drawn, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), *[pa.array(np.ascontiguousarray(longs[:, i])) for i in range(LONGS)]], ["node", *[f"b{i}" for i in range(LONGS)]])

    return texts.mapInArrow(draw, ", ".join(["node long", *[f"b{i} long" for i in range(LONGS)]]))


def lacking(x: str, y: str) -> Column:
    """How many shingles of x, at least, y lacks."""
    return reduce(Column.__add__, [F.bit_count(F.col(f"{x}.b{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}.b{i}")))) for i in range(LONGS)])


def compare_runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(a, b, sim) of rows (a, b, text) that follow the row of their leader (a, null, text)."""
    lead = (np.zeros(0, U), np.zeros(0, np.int64))
    for batch in by_bytes(batches, "text"):
        n = batch.num_rows
        d, h, c = shingle_bags(*text_words(batch.column("text")), n, size)
        cut, heads = np.searchsorted(d, np.arange(n + 1)), np.flatnonzero(batch.column("b").is_null().to_numpy(zero_copy_only=False))
        sims = np.zeros(n)
        for start, end in zip([-1, *heads.tolist()], [*heads.tolist(), n]):
            if start >= 0:
                lead = h[cut[start] : cut[start + 1]].copy(), c[cut[start] : cut[start + 1]].copy()
            first = start + 1
            if end > first:
                own = slice(cut[first], cut[end])
                sims[first:end] = overlap_with(lead, d[own] - first, h[own], c[own], end - first)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims)], ["a", "b", "sim"]).filter(batch.column("b").is_valid())


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, size: int = 5, bands: int = 24, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id) for every row of docs; class_id: the smallest id of its class."""
    text_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    signed = stored(signatures(docs, size, bands, rows), "signatures")
    nodes = signed.groupBy("m1", "m2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("at"), F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    held = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    met = held.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    held = stored(held.join(met, "bucket"), "buckets")
    central = held.groupBy("node").agg(F.sum("members").alias("central"))
    leaders = held.join(central, "node").groupBy("bucket").agg(F.max(F.struct("central", -F.col("node"))).alias("top")).select("bucket", (-F.col("top").getField("col2")).alias("leader"))
    members = stored(held.join(leaders, "bucket").filter("node <> leader").drop("members"), "members")
    star = stored(members.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "star")

    def texts_of(asked: DataFrame) -> DataFrame:
        """asked (node, ...) with the texts of its nodes. A row of documents that is repeated whole repeats its node."""
        want = asked.join(nodes.select("node", F.col("at.id").alias("want"), F.col("at.th").alias("want_th")), "node")
        want = small(stored(want, "wanted-texts"))
        return docs.join(want, (F.col("th") == F.col("want_th")) & F.col("id").eqNullSafe(F.col("want"))).select(*asked.columns, "text")

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b, sim) of stored, distinct pairs (a, b). A leader a goes to as many groups as its members fill, and each group reads its text once, ahead of the members."""
        crowded = small(stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")).filter("parts > 1"), "crowded-leaders"))
        parts = F.coalesce("parts", F.lit(1))
        dealt = stored(pairs.join(crowded, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part")), "dealt-pairs")
        lead = stored(texts_of(dealt.select(F.col("a").alias("node")).distinct()).dropDuplicates(["node"]), "leaders-texts")
        lead = dealt.select("a", "part").distinct().join(lead, F.col("a") == F.col("node")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
        members = texts_of(dealt.withColumn("node", F.col("b"))).select("a", "part", "b", "text")
        runs = lead.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).select("a", "b", "text")
        return stored(runs.mapInArrow(lambda batches: compare_runs(batches, size), "a long, b long, sim double"), "similarities").dropDuplicates(["a", "b"])

    sims = stored(verified(star), "star-similarities")
    links = sims.filter(F.col("sim") >= threshold - 1e-9)
    comps = stored(components(links), "components")
    # pairs of different components in a bucket, of which neither is the leader
    label = members.join(comps, "node", "left").join(comps.select(F.col("node").alias("leader"), F.col("comp").alias("lc")), "leader", "left")
    label = label.join(sims.select(F.col("a").alias("leader"), F.col("b").alias("node"), "sim"), ["leader", "node"])
    label = label.select("bucket", "node", "leader", "n", "sim", F.coalesce("comp", "node").alias("comp"), F.coalesce("lc", "leader").alias("lc"))
    stray = stored(label.filter("comp <> lc"), "strays")
    if not stray.isEmpty():
        near = stored(label.join(stray.select("bucket").distinct(), "bucket", "left_semi"), "near-strays")
        taking_part = near.select("node").unionByName(near.select(F.col("leader").alias("node"))).distinct()
        own = stored(own_mass(texts_of(taking_part).dropDuplicates(["node"]), size), "own-mass")
        bits = stored(bitmaps(texts_of(taking_part).dropDuplicates(["node"]), size), "bitmaps")

        def able(df: DataFrame) -> DataFrame:
            """With bitmaps; without the nodes that can't have a partner, as they share too few shingles with all others."""
            df = df.join(own, "node", "left").withColumn("shared", F.col("n") - F.coalesce("own", F.lit(0)))
            return df.filter(F.col("shared") >= threshold * F.col("n") - 1e-9).join(bits, "node")

        x, y = able(stray).alias("x"), able(near).alias("y")
        close = F.abs(F.col("x.sim") - F.col("y.sim")) <= 1 - threshold + 1e-9
        asked = (F.col("x.n") + F.col("y.n")) * (threshold / (1 + threshold)) - 1e-9
        enough = (F.least("x.shared", "y.shared", "x.n", "y.n") >= asked) & (F.col("x.n") - lacking("x", "y") >= asked) & (F.col("y.n") - lacking("y", "x") >= asked)
        once = (F.col("y.comp") == F.col("y.lc")) | (F.col("x.node") < F.col("y.node"))
        rest = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.comp") != F.col("y.comp")) & close & enough & once)
        rest = rest.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.least("x.comp", "y.comp").alias("ca"), F.greatest("x.comp", "y.comp").alias("cb"))
        rest = stored(rest.distinct(), "rest")
        late = verified(rest.select("a", "b").distinct()).filter(F.col("sim") >= threshold - 1e-9)
        late = stored(late.join(rest, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "late-links")
        if not late.isEmpty():
            merged = components(late).withColumnRenamed("comp", "final")
            alone = late.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("comp"))
            every = comps.unionByName(alone.join(comps.select("node"), "node", "left_anti"))
            comps = every.join(merged.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("final", "comp").alias("comp"))
    named = nodes.select("node", "least", "m1", "m2").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = named.groupBy("comp").agg(F.min("least").alias("class_id"))
    named = named.join(names, "comp").select("m1", "m2", "class_id")
    classed = signed.select("id", "m1", "m2").join(named, ["m1", "m2"]).select("id", "class_id")
    bare = docs.filter(~F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")).select("id", F.col("id").alias("class_id"))
    return classed.unionByName(bare).withColumnRenamed("id", id_col)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 5, 0) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS g FROM p),
c AS (SELECT doc_id, g, count(*) AS n FROM s GROUP BY doc_id, g),
t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS n FROM c a JOIN c b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT o.a, o.b FROM o JOIN t x ON x.doc_id = o.a JOIN t y ON y.doc_id = o.b WHERE 5 * o.n >= 4 * (x.n + y.n - o.n)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT node AS doc_id, min(root) AS class_id FROM r GROUP BY node
"""
