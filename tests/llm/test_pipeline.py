"""Every stage of the pipeline against brute force, on a table with null, repeated and clashing everything."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from causeway.llm import toxicity
from tests.llm.test_corpus import classes, contamination, invented
from tests.llm.test_layout import filled

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, gone string, hit string, copies int, size string"
BAD = ["vilescum", "vilecur", "vilerat", "grubber", "grubling", "grubcur"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels and benchmark as Parquet."""
    rng, root = random.Random(12), tmp_path_factory.mktemp("corpus")
    rows, labels = [], []
    for i in range(900):
        w = invented(rng, rng.randrange(20, 90), ["ber%d" % j for j in range(400)])
        if bad := i % 5 == 0:
            at = rng.randrange(len(w))
            w[at:at] = rng.sample(BAD, 4)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    item = " ".join(invented(rng, 25))
    plain = [t for i, t in rows if i % 5]
    for i in range(120):  # copies and near copies under used, new and null ids
        t = plain[rng.randrange(len(plain))]
        w = t.split()
        if i % 3 == 0 and len(w) > 60:
            w[rng.randrange(len(w))] = "changed"
        rows.append((rng.choice([None, 2, 2, 7, 5000 + i]), " ".join(w)))
    rows += [(None, " ".join(invented(rng, 30))) for _ in range(10)] + [(3, " ".join(invented(rng, 30))) for _ in range(10)]
    rows += [(6000 + i, f"{' '.join(invented(rng, 10))} {item} {' '.join(invented(rng, 10))}") for i in range(5)] + [(None, item), (3, item)]
    rows += [(None, None), (None, ""), (4, ""), (4, ""), (8, "?!"), (9, " ".join(invented(rng, 20_000)))]
    docs = spark.createDataFrame([(i, t, rng.choice(["en", None]), rng.choice(["a", "b", "b", "c", None]), 0, 1, "k", "g", "h", 2, "s") for i, t in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "...")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), item


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_against_brute_force(spark, folder, tmp_path):
    root, item = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def kept(name):
        stages[name](spark, docs, root).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "sharding" or out.columns == docs.columns
        return out

    model = toxicity.trained(spark, root)
    scores = model.scores()
    toxic = lambda t: model.probability(*model.evidence(*toxicity.scan(scores, t or ""))[:2]) >= 0.5
    before, docs = rows_of(docs), kept("toxicity")
    assert rows_of(docs) == Counter({k: n for k, n in before.items() if not toxic(k[1])})
    assert not any("vile" in (t or "") and i % 5 for i, t in rows_of(docs) if i) and len(before) - len(rows_of(docs)) > 150

    before = [k for k, n in rows_of(docs).items() for _ in range(n)]
    own = classes([(row, t) for row, (_, t) in enumerate(before)])
    groups = defaultdict(list)
    for row, least in own:
        doc, text = before[row]
        wordless = not any(c.isalnum() for c in text or "")
        groups[("bare", doc, text or "") if wordless and doc is not None else ("row", row) if wordless else ("class", least)].append((doc is None, doc or 0, row))
    docs = kept("near_dedup")
    after = rows_of(docs)
    ids = lambda rows: sorted(min(g)[:2] for g in rows)
    assert sorted((i is None, i or 0) for (i, _), n in after.items() for _ in range(n)) == ids(groups.values())
    texts = {k: {before[x[2]][1] for x in g} for k, g in groups.items()}
    assert all(sum(n for (_, t), n in after.items() if t in texts[k]) >= 1 for k in groups)

    before, clean = rows_of(docs), {t: n_hit == 0 for t, (_, _, n_hit, _) in zip(*(lambda ts: (ts, [contamination([(0, t)], [(1, item)])[0] for t in ts]))(sorted({t for _, t in rows_of(docs)}, key=str)))}
    docs = kept("decontamination")
    assert rows_of(docs) == Counter({k: n for k, n in before.items() if clean[k[1]]}) and not all(clean.values())

    before = docs.collect()
    sizes = Counter()
    for r in before:
        sizes[r.source] += len((r.text or "").split())
    want, docs = filled(sizes), kept("mixing")
    took, times = Counter(), Counter()
    for r in docs.collect():
        took[r.source] += len((r.text or "").split())
        times[r.doc_id, r.text, r.source] += 1
    assert all(abs(took[s] - want[s]) <= 1 for s in want)
    had = Counter((r.doc_id, r.text, r.source) for r in before)
    assert set(times) <= set(had) and all(n <= 3 * had[k] for k, n in times.items())
    assert all(times[k] == n for k, n in had.items() if not (k[1] or "").split())

    before, out = docs.collect(), kept("sharding").collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((r.doc_id, size(r.text), zlib.crc32((r.text or "").encode())) for r in before)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert set(by) <= set(range(8)) and all(sorted(r.slot for r in s) == list(range(len(s))) for s in by.values())


def test_ids_don_t_decide(spark, folder):
    root, _ = folder
    rng = random.Random(1)
    a, b, c, d, e = (" ".join(invented(rng, 40)) for _ in range(5))
    six = [(None, a), (None, b), (None, c), (3, d), (7, d), (7, e)]
    docs = spark.createDataFrame(six, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(0)})
    out = corpus_pipeline.keep_one_of_each_class(spark, docs, root)
    assert rows_of(out) == Counter([(None, a), (None, b), (None, c), (3, d), (7, e)])


def test_the_whole_run(spark, folder):
    root, _ = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, root)
    key = lambda df: Counter((r.doc_id, r["size"], r.text_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, root)) == key(docs)
