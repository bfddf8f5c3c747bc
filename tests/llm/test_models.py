"""Toxicity, secrets, licenses and the pipeline: held-out accuracy, brute force, stage decisions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from causeway.llm import license_texts, licenses, secrets, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BAD = ["vilescum", "vilecur", "vilerat", "grubber", "grubling"]


def prose(rng, n):
    return ["".join(rng.choice(["an", "ber", "cho", "den", "el", "fur"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(1500):
        w = prose(rng, rng.randrange(5, 120))
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(BAD) + rng.choice(["", "s", "ish", "dom"])
        rows.append((i, " ".join(w), "en", "s", len(w)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    train = labels.filter(toxicity.fold(F.col("doc_id")) != 0)
    model = toxicity.train(docs, train)
    out = toxicity.score_toxicity(docs, model).join(labels, "doc_id").filter(toxicity.fold(F.col("doc_id")) == 0).collect()
    right = sum((r.score >= 0.5) == bool(r.toxic) for r in out)
    assert len(out) > 200 and right / len(out) > 0.97
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = [texts[r.doc_id][p.start : p.end] for r in out if r.toxic and r.score >= 0.5 for p in r.passages]
    assert found and sum(any(b[:4] in f for b in BAD) for f in found) / len(found) > 0.95
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in toxicity.score_toxicity(docs, model).filter("score < 0.5").collect()}


def test_toxicity_edges(spark, labelled):
    docs, labels = labelled
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "", "x", "y", 1), (2, "vilescum " * 5000, "x", "y", 1)], SCHEMA)
    scored = toxicity.score_toxicity(odd, toxicity.train(docs, labels)).collect()
    assert len(scored) == 4 and all(0 <= r.score <= 1 for r in scored)
    assert all(r.score < 0.5 for r in scored if r.doc_id != 2) and [r.score > 0.5 for r in scored if r.doc_id == 2] == [True]
    assert toxicity.score_toxicity(odd.limit(0), toxicity.train(docs, labels)).count() == 0
    one = toxicity.train(docs, labels.filter("toxic = 0"))
    assert {round(r.score, 3) < 0.01 for r in toxicity.score_toxicity(odd, one).collect()} == {True}
    assert toxicity.train(docs, labels.limit(0)).constant == 0.5


def test_segments_are_ruzzo_tompa():
    """Against the definition: split at the best segment, recursively."""

    def slow(s, lo, hi):
        top = None
        for i in range(lo, hi):
            for j in range(i + 1, hi + 1):
                v = sum(s[i:j])
                if v > 0 and (top is None or v > top[0] or (v == top[0] and j - i < top[2] - top[1])):
                    top = (v, i, j)
        return [] if top is None else slow(s, lo, top[1]) + [(top[1], top[2], top[0])] + slow(s, top[2], hi)

    rng = random.Random(0)
    for _ in range(300):
        s = [rng.choice([-3, -2, -1.25, 1, 2, 3.5]) + rng.random() / 8 for _ in range(rng.randrange(14))]
        assert [(a, b) for a, b, _ in sorted(toxicity.segments(np.array(s)))] == [(a, b) for a, b, _ in slow(s, 0, len(s))]


def test_secret_candidates_and_scores(spark):
    rng = random.Random(9)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, truth = [], {}
    for i in range(400):
        w = prose(rng, 30) + ["anberchodenelfuranber"]
        kind = i % 4
        value = hexed(40)
        w.insert(rng.randrange(30), {0: f'token = "{value}"', 1: f"sha1 checksum {value}", 2: "anbercho", 3: f"password={hexed(20)}"}[kind])
        rows.append((i, " ".join(w), "en", "s", 0))
        truth[i] = kind in (0, 3)
    rows += [(1000, None, None, None, None), (1001, "", "x", None, 0), (1002, "\u0001 " + "A" * 3000, "x", None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = secrets.candidates(docs)
    seen = Counter((r.id, r.candidate) for r in found.collect())
    assert seen == Counter((i, m) for i, t, *_ in rows if t for m in __import__("re").findall(secrets.CANDIDATE, t))
    labels = found.filter("id < 1000").withColumn("label", (F.col("left").rlike("token = |password=") & F.col("candidate").rlike("^[0-9a-f]+$")).cast("int"))
    out = secrets.scan_secrets(docs, labels.filter("id < 300")).filter("doc_id between 300 and 399").collect()
    flagged = {r.doc_id for r in out if r.secret}
    assert flagged == {i for i in range(300, 400) if truth[i]}
    assert secrets.scan_secrets(docs.limit(0), labels.limit(0)).count() == 0
    assert {r.score for r in secrets.scan_secrets(docs, labels.limit(0)).select("score").distinct().collect()} == {0.5}


def noticed(text, slack=0.25):
    return [(text[s:e], name) for s, e, name, _, _ in licenses.findings(text, licenses.classes(license_texts.templates(), slack), {})]


def test_licenses(spark):
    text = "some prose\nLicensed under CC BY-NC 4.0.\n\nLicensed under CC BY-NC 3.0.\nthe license of the poet\nlicensed UNDER the apache license, version 2.0\n\nThis work is licensed under the\nGNU General Public License, version 3.\n"
    rows = [(1, text, "en", "s", 0), (2, None, None, None, None), (3, "", None, None, None), (4, "Released under the MIT License.\nReleased under the MIT License.", None, None, None), (5, "no notice at all", None, None, None), (4, "SPDX-License-Identifier: MIT", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("license", F.lit("x")).withColumn("start", F.lit(1)).withColumn("id", F.lit(9))
    out = licenses.scan_licenses(docs).orderBy("doc_id", "start").collect()
    got = [(r.doc_id, text[r.start : r.end] if r.doc_id == 1 else r.start, r.license) for r in out]
    assert got == [
        (1, "Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"), (1, "licensed UNDER the apache license, version 2.0", "Apache-2.0"),
        (1, "This work is licensed under the\nGNU General Public License, version 3", "GPL-3.0"), (4, 0, "MIT"), (4, 0, "MIT"), (4, 32, "MIT"),
    ]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_several_licenses_in_a_block():
    assert [n for _, n in noticed("Licensed under the MIT License. Licensed under the Apache License, Version 2.0.")] == ["MIT", "Apache-2.0"]
    head = "Copyright (c) 1999 The Authors. All rights reserved.\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    assert [n for _, n in noticed(head)] == ["BSD"]
    assert noticed("Copyright 2001 A. Author. All rights reserved.") == [("All rights reserved", "Proprietary")]
    assert noticed("Licensed under the MIT License.\n\nAll rights reserved.")[1][1] == "Proprietary"
    assert [n for _, n in noticed(license_texts.TEXTS["BSD-3-Clause"][0])] == ["BSD-3-Clause"]
    assert [n for _, n in noticed(license_texts.TEXTS["BSD-2-Clause"][0])] == ["BSD-2-Clause"]


def test_every_wording_is_found_wherever_it_stands():
    """All templates, alone, in prose, with a word changed, and across the cuts of a long line."""
    rng = random.Random(6)
    known = licenses.classes(license_texts.templates(), 0.25)
    said = lambda t: [n for _, _, n, _, _ in licenses.findings(t, known, {})]
    lost = 0
    for name, texts in license_texts.templates().items():
        for t in texts:
            assert said(t) == [name]
            assert said(" ".join([*prose(rng, 40), "license", *prose(rng, 40)]) + "\n" + t + "\n" + " ".join(prose(rng, 90))) == [name]
            long = prose(rng, 700)
            for at in range(0, 700, 3):
                long[at] = "warranty"
            at = rng.randrange(700)
            lost += said(" ".join([*long[:at], t, *long[at:]])) != [name]
    assert lost == 0


def published(text, mark, width=72):
    """A notice as files have it: a paragraph a numbered or spoken part, blank lines between, each line behind a comment mark."""
    import re
    import textwrap

    parts = re.split(r" (?=\d\. |\* |THE SOFTWARE IS|THIS SOFTWARE IS|IN NO EVENT|This program is distributed|Unless required|The above copyright|Permission is granted|If a copy)", text)
    return f"\n{mark}\n".join("\n".join(mark + " " + line for line in textwrap.wrap(p, width)) for p in parts)


@pytest.mark.parametrize("mark", ["", "#", " *", "//"])
def test_published_forms_cross_blank_lines(mark):
    """Whole notices with blank lines and comment marks give their license alone, with all their words."""
    for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "Zlib"):
        for t in license_texts.TEXTS[name]:
            body = published(t, mark)
            for head in ("", f"{mark} Copyright (c) 2011, The Authors\n{mark} All rights reserved.\n{mark}\n"):
                found = noticed(f"some words before\n\n{head}{body}\n\nand some after\n".replace("\n \n", "\n\n"))
                assert [n for _, n in found] == [name], (name, mark, head)
                assert len(found[0][0].split()) >= 0.95 * len(body.split()) - 2
    gpl = license_texts.TEXTS["GPL-3.0"]
    assert noticed(gpl[1] + "\n\nunrelated words of another kind")[0][1] == "GPL-3.0"


def test_changed_words():
    t = license_texts.TEXTS["MIT"][0]
    words = t.split(" ")
    assert [n for _, n in noticed(" ".join("foobar" if i % 11 == 5 else w for i, w in enumerate(words)))] == ["MIT"]
    assert "GPL-3.0" not in [n for _, n in noticed("Licensed under the GNU General Public License, version 4.")]
    assert noticed("Licensed under the Foo License.") == []
    assert noticed("licensed under the MIT terms of use") == [("licensed under the MIT", "MIT")]  # one of five words is missing


def test_long_lines_take_linear_time():
    import time

    known, rng = licenses.classes(license_texts.templates(), 0.25), random.Random(2)
    for text in ("the license of poets " * 50_000, ("x" * 400 + " license ") * 2500, "\n \n" * 300_000 + "license", " ".join(prose(rng, 120_000)) + " Licensed under the MIT License."):
        began = time.process_time()
        found = licenses.findings(text, known, {})
        assert time.process_time() - began < 6 and len(found) == text.count("MIT License")


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("gone__", F.lit(1)).withColumn("copies", F.lit(2))
    again = docs.limit(3)
    docs = docs.unionByName(again)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert 0 < out.count()
    kept = corpus_pipeline.keep_one_of_each_class(spark, docs, sf_dir)
    from causeway.llm.near_dup import near_duplicates

    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({r.class_id for r in near_duplicates(docs).collect()})


def test_pipeline_on_an_empty_table(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    by = Counter(r.shard for r in out)
    assert out and set(by) <= set(range(8))
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in by.items())


def test_toxic_passages_after_uses_of_their_words():
    words = ["vilescum", "vilecur", "vilerat", "grubber", "grubling", "grubcur"]
    scores = toxicity.TokenScores({}, 0.5)
    scores.update(dict.fromkeys(words, 2.0))
    model = toxicity.Model({}, 0.5, 0.5, 0.05)
    filler = ["an"] * 40
    late = [x for w in words for x in (w, *filler)] + words
    n, found = toxicity.scan(scores, " ".join(late))
    assert [p[:3] for p in model.evidence(n, found)[2]] == [(len(late) - 6, len(late), 12.0)]
    n, found = toxicity.scan(scores, " ".join(words + filler + words))
    assert [p[:3] for p in model.evidence(n, found)[2]] == [(0, 6, 12.0), (46, 52, 12.0)]
    assert all(s <= 2 for _, _, s in toxicity.scan(scores, "vilescum an an an " * 500)[1])  # one word again and again is no passage


def test_nothing_learnt_rejects_nothing(spark, sf_dir, labelled, monkeypatch):
    docs, labels = labelled
    elsewhere = spark.createDataFrame([(-1, 1), (-2, 0)], "doc_id long, toxic int")
    inner = labels.filter(toxicity.fold(F.col("doc_id")) == 0)
    for none in (labels.limit(0), elsewhere, inner, labels.filter("toxic = 1")):
        monkeypatch.setattr(toxicity, "table", lambda s, d, name, none=none: docs if name == "documents" else none)
        assert corpus_pipeline.drop_toxic(spark, docs, sf_dir).count() == docs.count()
        assert toxicity.op5_toxicity(spark, sf_dir).filter("predicted = 1 or score >= 0.5").isEmpty()


def test_stages_decide_by_row(spark, sf_dir):
    rng = random.Random(3)
    a, b, x, alone = (" ".join(prose(rng, 40)) for _ in range(4))

    def kept(rows, stage=corpus_pipeline.keep_one_of_each_class):
        out = stage(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA), sf_dir)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        return Counter((r.doc_id, r.text) for r in out.collect())

    assert kept([(1, x), (3, x), (3, alone)]) == Counter([(1, x), (3, alone)])
    assert kept([(1, b), (3, a), (3, b), (5, a)]) == Counter([(1, b), (3, a)])
    assert kept([(1, x), (None, x), (None, alone), (None, a), (None, a)]) == Counter([(1, x), (None, alone), (None, a)])
    assert kept([(1, x), (1, x), (2, ""), (2, ""), (None, ""), (None, None)]) == Counter([(1, x), (2, ""), (None, ""), (None, None)])
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("length(text) > 50").first().text
    rows = [(3, item), (3, x), (None, item), (None, alone), (4, a)]
    assert kept(rows, corpus_pipeline.drop_contaminated) == Counter([(3, x), (None, alone), (4, a)])


def test_announced_secrets_of_any_alphabet(spark):
    rng = random.Random(4)
    drawn = lambda n, of="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(rng.choice(of) for _ in range(n - 1)) + "7"
    hexes = "0123456789abcdef"
    forms = [lambda: ("aws_secret_access_key=", drawn(40)), lambda: ('password = "', drawn(24)), lambda: ('token = "', drawn(40, hexes)), lambda: ('note "', "glpat-" + drawn(20)), lambda: ("sha1 checksum ", drawn(40, hexes)), lambda: ("", "internationalisation"), lambda: ("", drawn(40))]
    rows, value = [], {}
    for i in range(350):
        before, value[i] = forms[i % 7]()
        rows.append((i, " ".join([*prose(rng, 20), before + value[i], *prose(rng, 3)]), "en", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = secrets.labelled_by_issuer(docs)
    told = {r.candidate: r.label for r in labels.collect()}
    assert {i: told.get(v) for i, v in value.items()} == {i: (1, 1, 1, 1, 0, 0, None)[i % 7] for i in value}
    assert {r.id: r.left[-22:] for r in secrets.candidates(docs).filter("nth = 2").collect()} == {i: "aws_secret_access_key=" for i in value if i % 7 == 0}
    flagged = {(r.doc_id, r.candidate) for r in secrets.scan_secrets(docs, labels).filter("secret").collect()}
    assert {(i, value[i]) for i in value if i % 7 < 4} <= flagged
    assert not any((i, value[i]) in flagged for i in value if i % 7 in (4, 5))
    long = spark.createDataFrame([(1, "abc" * 100, None, None, None)], SCHEMA)
    assert secrets.common_trigrams(long) == ["abc", "bca", "cab"]


def test_clashing_columns_repeats_and_long_texts(spark, labelled):
    docs, labels = labelled
    rng = random.Random(7)
    value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(1, f'token = "{value}"', "en", "s", 0), (1, f'token = "{value}"', "en", "s", 0), (2, " ".join([*prose(rng, 40_000), f"password={value}", "vilescum vilecur vilerat grubber"]), None, None, None)]
    odd = spark.createDataFrame(rows, SCHEMA)
    names = ["score", "passages", "n_tokens", "text_", "id", "y", "part", "left", "right", "candidate", "label", "nth", "path", "parts", "g", "n", "word", "secret", "features", "probability"]
    more = odd.withColumns({n: F.lit("x") for n in names})
    model = toxicity.train(docs.withColumns({n: F.lit("x") for n in names}), labels.withColumns({n: F.lit("x") for n in ("id", "y", "part", "text")}))
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(toxicity.score_toxicity(more, model)) == plain(toxicity.score_toxicity(odd, model))
    assert toxicity.reject_toxic(more, model).columns == more.columns
    found = secrets.candidates(more)
    assert sorted(r.id for r in found.filter(F.col("candidate") == value).collect()) == [1, 1, 2]
    marked = secrets.label(found)
    assert plain(secrets.scan_secrets(more, marked).select("doc_id", "candidate", "secret")) == plain(secrets.scan_secrets(odd, secrets.label(secrets.candidates(odd))).select("doc_id", "candidate", "secret"))


def test_neighbouring_words_are_learnt(spark):
    """Secrets and checksums of one alphabet, told apart only by words that no pattern knows; labels are the truth; judged on held-out documents."""
    rng = random.Random(21)
    rows, truth = [], {}
    for i in range(600):
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        truth[i] = rng.random() < 0.4
        rows.append((i, " ".join([*prose(rng, 15), rng.choice(["zugangsmarke", "losungswort"] if truth[i] else ["pruefwert", "fingerabdruck"]), "ist", value, *prose(rng, 10)]), "en", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = secrets.candidates(docs).withColumn("label", F.array_contains(F.array(*[F.lit(i) for i, t in truth.items() if t]), F.col("id").cast("int")).cast("int"))
    out = secrets.scan_secrets(docs, labels.filter("id < 400")).filter("doc_id >= 400").collect()
    hit, found, all_ = sum(r.secret and truth[r.doc_id] for r in out), sum(r.secret for r in out), sum(truth[r.doc_id] for r in out)
    assert len(out) == 200 and hit / found > 0.95 and hit / all_ > 0.95, (hit, found, all_)
