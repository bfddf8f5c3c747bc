"""Decontamination, line dedup, top-k, near-duplicates: brute force on hostile small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from causeway.llm import decontaminate, line_dedup, near_dup, topk

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, id string, w string, k long, found string, start int, n_words int, node long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", 1, "c", 2, 3, 4) for i, t in rows], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def words(text):
    return WORD.findall(lower(text or ""))


def invented(rng, n, vocabulary=None):
    return [vocabulary[rng.randrange(len(vocabulary))] if vocabulary else "w%d" % rng.randrange(10**6) for _ in range(n)]


def contamination(rows, items):
    out = []
    for i, text in rows:
        w, hit, held = words(text), set(), set()
        for item, t in items:
            x = words(t)
            n = min(10, len(x))
            spans = {tuple(x[p : p + n]) for p in range(len(x) - n + 1)} if x else set()
            for p in range(len(w) - n + 1) if x else ():
                if tuple(w[p : p + n]) in spans:
                    hit |= set(range(p, p + n))
                    held.add(str(item))
        out.append((i, len(w), len(hit), ",".join(sorted(held))))
    return sorted(out, key=repr)


def test_decontaminate(spark):
    rng = random.Random(6)
    few = ["a", "b", "É", "c1", "the"]
    items = [(1, " ".join(invented(rng, 25, few))), (2, "The a, b"), (3, "x"), (4, None), (5, "..."), (6, " ".join(invented(rng, 14))), (10, "The a b"), (None, "é É q")]
    long = " ".join(invented(rng, 4000, few))
    rows = [(i, " ".join(invented(rng, rng.randrange(60), few))) for i in range(60)] + [(100, items[5][1].upper() + "! " + items[5][1]), (101, None), (102, ""), (103, "?!"), (104, "é É q x"), (105, long), (105, "the A B"), (105, "the A B"), (None, "x y"), (None, "y")]
    rows += [(200 + i, "THE a b " + "common words here") for i in range(40)]
    got = decontaminate.find_contamination(frame(spark, rows), spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, item string"))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids)) for r in got.collect()), key=repr) == contamination(rows, [(i if i is not None else "", t) for i, t in items])


def test_decontaminate_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.find_contamination(frame(spark, [(1, "a b")]), none).collect()
    assert [(r.n_words, r.n_hit, r.item_ids) for r in out] == [(2, 0, [])]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.find_contamination(frame(spark, []), some).count() == 0


def deduped(rows, least=10):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders: dict[str, set] = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(float("inf") if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        at = float("inf") if i is None else i
        kept = [x for x in lines if not (len(key(x)) >= least and len(holders[key(x)]) > 1 and at != min(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_bits", [1 << 29, 1 << 19])
def test_line_dedup(spark, max_bits):
    rng = random.Random(7)
    pool = ["short", "exactly 10", "ÉÉÉÉÉÉÉÉÉÉ", "ééééééééé", "A Common Line, everywhere", " a common line, EVERYWHERE\t", "\x0bpadded line here\x0c", "", "line %d with words", " not stripped text"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"line {rng.randrange(40)} with words" for _ in range(rng.randrange(9)))) for i in range(150)]
    rows += [(3, "again in three, again\nA Common Line, everywhere"), (None, "A Common Line, everywhere\nonly in one document"), (None, "only in one document"), (900, None), (901, ""), (902, "x" * 50000 + "\n" + "exactly 10")]
    got = line_dedup.dedup_lines(frame(spark, rows).repartition(5), max_bits=max_bits).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got), key=repr) == deduped(rows)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_bloom_pairs_merge_without_losing_repeats():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    bits, k = line_dedup.filter_shape(4000, 16, 1 << 29)
    parts = [h[:2500], h[1500:]]
    maps = []
    for p in parts:
        once = np.zeros(bits // 8, np.uint8)
        line_dedup.put(once, line_dedup.probes(p, bits, k))
        maps.append(once)
    twice = maps[0] & maps[1]
    hits = line_dedup.has(twice, line_dedup.probes(h, bits, k))
    assert hits[1500:2500].all() and hits[:1500].mean() < 0.05


def best(vectors, queries, k):
    out = []
    for q, a in queries:
        scored = sorted((-min(max(sum(x * y for x, y in zip(a, b)), -(1 << 63)), (1 << 63) - 1), i) for i, b in vectors if i != q and len(a) == len(b))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k(spark):
    rng = random.Random(3)
    raw = [(i, [rng.uniform(-1, 1) for _ in range(40)]) for i in range(300)] + [(500 + i, [0.5] * 40) for i in range(60)]
    raw += [(1000, [0.1] * 3), (1001, [0.2] * 3), (1002, None), (1003, [0.1, None, 0.2]), (1004, [float("nan")] * 40), (1005, [float("inf")] * 40), (1006, []), (1007, [1e12] * 40), (None, [0.1] * 40)]
    raw += [(1010, [1e5, 1.0]), (1011, [2e5, 1.0]), (1012, [7e4, 1.0]), (1020, [1e9, -3.0]), (1021, [1e9, 5.5]), (1030, [1e300, 1.0]), (1031, [-1e308, 1.0])]
    raw += [(20, [rng.uniform(-1, 1) for _ in range(40)]), (20, [0.25] * 40), (7, [0.5] * 40)]
    df = spark.createDataFrame([(i, v, 7, 8) for i, v in raw], "vec_id long, embedding array<double>, block int, score int")
    sound = [(i, [int(np.floor(1024 * x)) if abs(x) < 1e305 else int(np.copysign(np.finfo(float).max, x)) for x in v]) for i, v in raw if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = best(sound, [x for x in sound if x[0] % 10 == 0], 7)
    for block in (16, 2048):
        got = topk.top_k(df.repartition(4), df.filter("vec_id % 10 = 0"), 7, block=block)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk.top_k(df.limit(0), df).count() == 0


def classes(rows, threshold=0.8):
    bags = []
    for _, t in rows:
        w = words(t)
        bags.append(Counter(tuple(w[p : p + 5]) for p in range(max(len(w) - 4, 1))) if w else Counter())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j]:
                both, every = (bags[i] & bags[j]).total(), (bags[i] | bags[j]).total()
                if both / every >= threshold - 1e-9:
                    root[max(find(i), find(j))] = min(find(i), find(j))
    least: dict[int, int | None] = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if bags[i] and d is not None:
            least[r] = min(least.get(r) if least.get(r) is not None else d, d)
    return sorted(((d, least.get(find(i)) if bags[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def test_near_duplicates(spark):
    rng = random.Random(11)
    rows, n = [], 0

    def add(w):
        nonlocal n
        rows.append((n, " ".join(w)))
        n += 1

    for _ in range(12):
        base = invented(rng, rng.randrange(60, 160))
        add(base)
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, 2)):
                w[rng.randrange(len(w))] = "changed%d" % rng.randrange(10**6)
            add(w)
    chain = invented(rng, 200)
    for _ in range(6):  # each near the next, the ends far apart
        add(chain)
        at = rng.randrange(190)
        chain = chain[:at] + invented(rng, 6) + chain[at + 6 :]
    hot = invented(rng, 120)
    for _ in range(60):
        w = list(hot)
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(len(w))] = "v%d" % rng.randrange(10**6)
        add(w)
    for t in ("Same, text!", "same TEXT", "same text again", "", None, "?!", "one", "ONE", "la " * 400, "la " * 450, "la " * 20):
        rows.append((n, t))
        n += 1
    rows += [(5, "a different text under a used number"), (None, rows[0][1]), (None, "nobody else has this one")]
    got = near_dup.near_duplicates(frame(spark, rows).repartition(6)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == classes(rows)
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_signatures_are_unbiased():
    import pyarrow as pa

    rng = random.Random(1)
    base = invented(rng, 300)
    other = base[:250] + invented(rng, 50)
    texts = [" ".join(base), " ".join(other), "a b c d e " * 30, "a b c d e " * 40]
    bags = near_dup.shingle_bags(*near_dup.text_words(pa.array(texts)), 4)
    sig = near_dup.bag_minhash(*bags, 4, 6000)
    for i, j in ((0, 1), (2, 3)):
        lead, (h, c) = ((bags[1][bags[0] == k], bags[2][bags[0] == k]) for k in (i, j))
        assert (sig[i] == sig[j]).mean() == pytest.approx(near_dup.overlap_with(lead, np.zeros(len(h), int), h, c, 1)[0], abs=0.03)


def test_bands_find_similar_pairs():
    """Recall of the bands by exact similarity, 0.8 and more."""
    import pyarrow as pa

    rng, met, missed = random.Random(5), Counter(), Counter()
    for _ in range(60):
        base = invented(rng, rng.randrange(100, 500))
        texts = [" ".join(base)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(1, max(2, len(w) // 38))):
                w[rng.randrange(len(w))] = "x%d" % rng.randrange(10**6)
            texts.append(" ".join(w))
        d, h, c = near_dup.shingle_bags(*near_dup.text_words(pa.array(texts)), len(texts))
        times = near_dup.bag_minhash(d, h, c, len(texts), 120).reshape(len(texts), 24, 5)
        sims = near_dup.overlap_with((h[d == 0], c[d == 0]), d, h, c, len(texts))
        for i in range(1, len(texts)):
            if sims[i] >= 0.8:
                met[int(sims[i] * 20)] += 1
                missed[int(sims[i] * 20)] += not (times[0] == times[i]).all(axis=1).any()
    assert all(met[b] > 50 for b in (16, 17, 18, 19)) and not missed.total()


def test_words_across_spans():
    import pyarrow as pa

    text = "x" * (near_dup.SPAN + 100) + " Ende, " + "été " * 3
    docs, hashes = near_dup.text_words(pa.array([text, "", "ÉTÉ été Ende"]))
    assert docs.tolist() == [0] * 5 + [2] * 3
    assert hashes[1] == hashes[7] and hashes[2] == hashes[6] and hashes[5] != hashes[6]


def test_digests_of_queries(spark, sf_dir):
    row = line_dedup.op2_line_dedup(spark, sf_dir).orderBy("doc_id").first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(f"doc_id = {row.doc_id}").first().text
    assert row.n_dropped or row.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
