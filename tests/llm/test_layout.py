"""Sharding, mixing and chat formatting: invariants, brute force and hostile inputs."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from causeway.llm import chat, mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, id string, curve string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, None, "x", "y", "z") for r in rows], DOCS)


def test_hilbert_is_a_continuous_bijection():
    cells = {sharding.hilbert_index((a, b, c), 3): (a, b, c) for a in range(8) for b in range(8) for c in range(8)}
    assert sorted(cells) == list(range(512))
    assert all(sum(abs(x - y) for x, y in zip(cells[i], cells[i + 1])) == 1 for i in range(511))


def test_shards(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "bb ccc", "é" * rng.randrange(90), None, ""]) if i % 3 else "hot copy", rng.choice(["en", "de", None]), rng.choice(["s1", "s22", None]), ) for i in range(900)]
    rows += [rows[5], (None, "loose", None, None)]
    out = sharding.shard_by_curve(docs(spark, rows), 4, unit_rows=16).collect()
    assert len(out) == len(rows)
    texts = dict((r[0], r[1] or "") for r in rows)
    by = defaultdict(list)
    for r in out:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        by[r.shard].append(r)
    assert sorted(by) == [0, 1, 2, 3]
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by.values())
    sizes = [sum(r["size"] for r in s) for s in by.values()]
    assert max(sizes) - min(sizes) < 0.12 * sum(sizes)
    total = Counter()
    for r in out:
        total[texts[r.doc_id]] += r["size"]
    light = [t for t, n in total.items() if n <= 0.05 * sum(sizes) / 4]
    assert all(len({r.shard for r in out if texts[r.doc_id] == t}) == 1 for t in light)
    for k in by:  # the run in curve order, large groups behind it
        run = [r.curve for r in sorted(by[k], key=lambda r: r.slot) if texts[r.doc_id] in light]
        assert run == sorted(run)


def test_groups_that_fit_stay_whole(spark):
    rng = random.Random(4)
    rows = [(i if i % 5 else None, f"group {i % 6}" * 4, "en", "s") for i in range(420)] + [(1000 + i, "loose " * rng.randrange(1, 9) + str(i), rng.choice(["en", "de"]), "s") for i in range(900)]
    d = docs(spark, rows)
    out = sharding.shard_by_curve(d, 4, unit_rows=16).join(d.select(F.col("doc_id").alias("i"), "text").distinct(), F.col("doc_id").eqNullSafe(F.col("i")) & (F.crc32("text") == F.col("text_crc32"))).collect()
    assert len(out) == len(rows)
    shards, bytes_, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in out:
        shards[r.text].add(r.shard)
        bytes_[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in shards.values())
    assert max(bytes_.values()) - min(bytes_.values()) < 0.12 * sum(bytes_.values()) / 4
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_packing():
    assert sharding.packed([("a", 9, 1), ("b", 6, 1), ("c", 5, 1), ("d", 3, 1)], 2, 10) == {"a": 0, "b": 1, "d": 1}


def test_shards_of_nothing(spark):
    assert sharding.shard_by_curve(docs(spark, [])).count() == 0


def test_write_shards(spark, tmp_path):
    d = docs(spark, [(i, "w " * i, "en", "s") for i in range(40)])
    sharding.write_shards(d, sharding.shard_by_curve(d, 2), str(tmp_path / "o"))
    back = spark.read.parquet(str(tmp_path / "o"))
    assert back.count() == 40 and set(d.columns) <= set(back.columns)


def test_fit_is_the_best_subset_sum():
    rng = random.Random(5)
    for _ in range(200):
        lens = np.array(rng.sample(range(1, 60), rng.randrange(1, 7)))
        cnts = np.array([rng.randrange(1, 4) for _ in lens])
        budget = rng.randrange(0, int((lens * cnts).sum()) + 30)
        sums = {0}
        for l, c in zip(lens, cnts):
            sums = {s + k * int(l) for s in sums for k in range(c + 1)}
        got = mixing.fit_lengths(lens, cnts, budget)
        assert (got >= 0).all() and (got <= cnts).all()
        assert abs(int((got * lens).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_fit_beyond_the_first_pool():
    fit = lambda lens, cnts, budget: mixing.fit_lengths(np.array(lens), np.array(cnts), budget).tolist()
    assert fit([70000, 100000], [1, 1], 100000) == [0, 1]
    assert fit([70000, 100000], [3, 2], 240000) == [2, 1]
    assert fit([70001, 100003, 250007], [2, 2, 1], 70001 + 250007) == [1, 0, 1]


def test_fit_of_a_large_source_is_exact_and_keeps_the_shape():
    rng = np.random.default_rng(1)
    lens = np.unique(rng.integers(1, 9000, 3000))
    cnts = rng.integers(1, 50, len(lens))
    total = int((lens * cnts).sum())
    got = mixing.fit_lengths(lens, cnts, total // 3)
    assert int((got * lens).sum()) == total // 3
    long = lens > 4000
    assert abs((got * lens)[long].sum() / (lens * cnts)[long].sum() - 1 / 3) < 0.02


def filled(sizes):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += share * weight[s]
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                free.discard(s)
    return target


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 40))), "en", rng.choice(["b", "a", "zz", "é", None])) for i in range(1500)]
    rows += [(9000 + i, "same text here", "en", "a") for i in range(700)] + [(1, None, "en", "a"), (1, "\x0b \n", None, "tiny"), (2, "x y", None, "tiny"), (2, "x y", None, "tiny")]
    d = docs(spark, rows)
    out = mixing.mix_sources(d, unit_rows=64).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = filled(sizes)
    took = Counter()
    for r in out:
        assert 0 <= r.copies <= 3 and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6
        took[r.source] += r.copies * r["size"]
    assert all(abs(took[s] - want[s]) <= 1 for s in want)
    key = lambda rows: sorted((r.doc_id or 0, r["size"], str(r.source), r.copies) for r in rows)
    assert key(out) == key(mixing.mix_sources(d.repartition(7), unit_rows=64).collect())
    assert mixing.mix_sources(docs(spark, [])).count() == 0


def test_chat_round_trip(spark):
    bits = [*chat.CHAT.controls, "\\", "\\\\", "<", "[", "</", "s>", "INST]", " ", "\n", "$1", "é", "<\\/s>", "ROLE x]\n", "text"]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "we[i]%rd<s>", None]), "".join(rng.choice(bits) for _ in range(rng.randrange(7))) if rng.random() < 0.95 else None) for c in range(300) for t in range(rng.randrange(1, 6))]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    out = chat.format_chats(df).withColumn("back", chat.read_chat(F.col("formatted"))).collect()
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0], r[1])):
        want[c].append((r or "", x or ""))
    assert len(out) == len(want)
    for r in out:
        assert [(t.role, t.text) for t in r.back] == want[r.conv_id]
        assert r.formatted == "<s>" + "".join(s.text for s in r.segments)
        assert sum(s.loss for s in r.segments) == sum(role == "assistant" for role, _ in want[r.conv_id])


def test_chat_machine(spark):
    cases = {1: (["user", "assistant"], True, -1), 2: (["system", "user", "assistant", "user", "assistant"], True, -1), 3: (["user"], False, -1), 4: (["assistant", "user"], False, 0), 5: (["user", "assistant", "assistant"], False, 2), 6: (["user", "tool"], False, 1)}
    df = spark.createDataFrame([(c, i, r, "x") for c, (rs, _, _) in cases.items() for i, r in enumerate(rs)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.valid, r.bad_turn) for r in chat.format_chats(df).collect()}
    assert got == {c: (v, b) for c, (_, v, b) in cases.items()}
    assert chat.format_chats(df.limit(0)).count() == 0
