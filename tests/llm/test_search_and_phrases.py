"""Operators 11 to 13 against brute force: hostile tables, shards and blocks of a few rows, collisions, arrivals."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import collocations, exact_dedup, lexical

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHES = "digest at content n keep hit row file batch id query rank score shard terms phrase total"
DOCS = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHES.split())


def docs_of(spark, rows):
    """rows: (doc_id, text, lang)."""
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES.split())) for r in rows], DOCS)


def invented(seed, n, vocabulary=30, words=40):
    """Rows of random words of uneven frequency with repeats, nulls, empty and very long texts, copies and rows without an id."""
    draw = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)] + ["É", "ÉA", "x y", "\x01b"]
    text = lambda k: "".join(names[min(int(draw.expovariate(0.2)), len(names) - 1)] + draw.choice([" ", " ", " ", "\t", ". ", "\n", ", "]) for _ in range(k))
    rows = [(i, text(draw.randrange(words)), draw.choice(["en", "de", None, "und"])) for i in range(n)]
    rows += [(n, None, None), (n + 1, "", "en"), (n + 2, " \t..\n", "de"), (n + 3, text(6000), "en"), (None, text(20), "en"), (None, rows[3][1], "de")]
    rows += [(n + 10 + i, rows[5][1].upper(), "en") for i in range(20)] + [rows[7]] * 3
    draw.shuffle(rows)
    return rows


# exact dedup


def equal_texts(rows):
    groups = {}
    for key, text, _ in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(key)
    out = []
    for text, ids in groups.items():
        best = max(ids, key=lambda i: (i is not None, i))
        out += [(i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return Counter(out), len(groups)


def held(found, wanted):
    rows = found.collect()
    counted, groups = wanted
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["digest"]) for r in rows) == counted
    assert sum(r["kept"] for r in rows) == groups and all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])


def test_exact_duplicates(spark):
    rows = invented(1, 60)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    held(exact_dedup.exact_duplicates(docs_of(spark, rows)), equal_texts(rows))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    assert exact_dedup.exact_duplicates(docs_of(spark, [])).count() == 0


def test_collisions_are_told_apart_by_their_bytes(spark):
    rows = invented(2, 40)
    found = exact_dedup.exact_duplicates(docs_of(spark, rows), digest=lambda c: F.substring(F.sha2(c, 256), 1, 1))
    counted, groups = equal_texts(rows)
    held(found, (Counter({(a, b, n, d[0]): x for (a, b, n, d), x in counted.items()}), groups))
    path = exact_dedup.fresh_path(spark, "collisions")
    docs_of(spark, rows).write.parquet(path)
    at = exact_dedup.contents(spark.read.parquet(path), "doc_id", "text", lambda c: F.lit("one"))
    keys = at.groupBy("digest").agg(F.count("*").alias("n"), F.max("at").alias("keep"))
    assert [r["same"] for r in exact_dedup.verified(at, keys).collect()] == [False]


def test_state_survives_arrivals(spark):
    rows = invented(3, 60)
    path, home = exact_dedup.fresh_path(spark, "arriving"), exact_dedup.fresh_path(spark, "home")
    docs_of(spark, rows[:30]).repartition(3).write.parquet(path)
    held(exact_dedup.duplicates_in(spark, path, home=home, files_per_batch=1), equal_texts(rows[:30]))
    docs_of(spark, rows[30:]).repartition(2).write.mode("append").parquet(path)
    held(exact_dedup.duplicates_in(spark, path, home=home, files_per_batch=1), equal_texts(rows))
    held(exact_dedup.duplicates_in(spark, path, home=home), equal_texts(rows))  # nothing new
    batches = {r[0] for r in spark.read.parquet(f"{home}/keys").select("batch").distinct().collect()}
    assert len(batches) >= 5  # a file a batch; none is read twice


# ranked search


def terms(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]


def ranked(docs, items, k):
    own = [(key, Counter(terms(text))) for key, text, _ in docs]
    own = [(key, c, sum(c.values())) for key, c in own if c]
    n, total = len(own), sum(x for _, _, x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for name, text, _ in items:
        scores = []
        for key, c, size in own:
            m = 10 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, key is None, key or 0))
        out += [(name, i, None if s[1] else s[2], -s[0]) for i, s in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_ranked_search(spark, monkeypatch, seed):
    for name, value in (("SHARD_DOCS", 7), ("SHARD_BYTES", 3000), ("BLOCK_DOCS", 3), ("FIRST", 2)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = invented(seed, 80), invented(seed + 10, 12, words=9)
    found = lexical.ranked_search(docs_of(spark, docs), docs_of(spark, items), k=4, query_col="doc_id", id_col="doc_id", block_terms=25).toDF("item_id", "rank", "doc_id", "score")
    assert Counter(map(tuple, found.collect())) == ranked(docs, items, 4)


def test_ranked_search_of_nothing(spark):
    some, none = docs_of(spark, invented(5, 10)), docs_of(spark, [])
    for a, b in ((some, none), (none, some), (docs_of(spark, [(1, None, None), (2, "..", None)]), some)):
        assert lexical.ranked_search(a, b, query_col="lang").count() == 0


def test_maxscore_finds_the_best_and_leaves_postings_alone(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 64)
    rng = np.random.default_rng(3)
    for _ in range(30):
        n_docs, lists = 700, []
        for share, height in ((0.9, 5), (0.7, 9), (0.4, 30), (0.05, 400), (0.02, 900)):
            at = np.flatnonzero(rng.random(n_docs) < share)
            lists.append((at, rng.integers(1, height + 1, len(at))))
        ends = np.cumsum([0, *[len(a) for a, _ in lists]])
        docs, gain = np.concatenate([a for a, _ in lists]), np.concatenate([g for _, g in lists])
        total = np.zeros(n_docs, np.int64)
        np.add.at(total, docs, gain)
        probes: list[int] = []
        found, scores = lexical.best_in(np.stack([ends[:-1], ends[1:]], axis=1), docs, gain, np.array([g.max() for _, g in lists]), n_docs, 5, 0, probes)
        least = np.sort(total)[-5]
        assert dict(zip(found.tolist(), scores.tolist())) == {d: s for d, s in enumerate(total.tolist()) if s >= least and s > 0}
        assert sum(probes) < len(docs) / 2


# collocations


def phrases(rows, min_count, first, percent):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang or "und"] += len(w)
            f.update((lang or "und", w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    lost = {(lang, w[i : i + m]) for (lang, w), b in good.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * b >= percent * good[lang, w[i : i + m]]}
    best = []
    for (lang, w), a in good.items():
        if (lang, w) not in lost:
            score, k = min(((1000 * a * n[lang]) // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            best.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out, seen = set(), Counter()
    for lang, score, a, phrase, left, right in sorted(best):
        seen[lang] += 1
        if seen[lang] <= first:
            out.add((lang, seen[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


@pytest.mark.parametrize("seed, percent", [(1, 100), (2, 60)])
def test_collocations(spark, monkeypatch, seed, percent):
    monkeypatch.setattr(collocations, "SHARD_BYTES", 2000)
    monkeypatch.setattr(collocations, "OPEN_BYTES", 4000)
    rows = invented(seed, 120, vocabulary=12)
    found = collocations.collocations(docs_of(spark, rows), min_count=6, first=40, drop_percent=percent)
    assert {tuple(r) for r in found.collect()} == phrases(rows, 6, 40, percent)


def test_collocations_of_nothing_and_past_64_bits(spark):
    assert collocations.collocations(docs_of(spark, []), min_count=1).count() == 0
    assert collocations.collocations(docs_of(spark, [(1, None, None), (2, "a", "en"), (3, "b.b", "en")]), min_count=1).count() == 0
    huge = spark.createDataFrame([("en", "a b", 10**15, 10**15, 10**15)], "lang string, phrase string, a long, l long, n long")
    score = collocations.cut_score("a", "n", "l", "l")
    assert huge.select(score.alias("s")).first()["s"] == 1000


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = invented(4, 60, vocabulary=10)
    wanted = {tuple(r) for r in collocations.collocations(docs_of(spark, rows), min_count=5).collect()}
    monkeypatch.setattr(collocations, "has", lambda bitmap, at: np.ones(at.shape[1], bool))
    assert {tuple(r) for r in collocations.collocations(docs_of(spark, rows), min_count=5).collect()} == wanted
