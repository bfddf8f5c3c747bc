"""Data operators against small brute-force answers."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.functions import columns, windows
from causeway.operators import bayes, binning, causal, rescale, stats
from causeway.sources import logs, tables


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        a = rng.choice("xyz")
        b = rng.choice([1, 2]) if a == "x" else rng.choice([2, 3])
        rows.append((i, a, b, (b + rng.choice([0, 0, 1])) % 3, rng.gauss(b, 1)))
    return spark.createDataFrame(rows, "id long, a string, b int, c int, v double")


def test_cut_matches_pandas(spark):
    rng = random.Random(4)
    values = [round(rng.uniform(0, 7), 1) for _ in range(400)] + [0.0, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 3, 7, 10):
        want = pd.cut(pd.Series(values), bins=np.linspace(0, 7, k + 1), labels=False, include_lowest=True)
        got = df.select(binning.cut_equal(F.col("x"), F.lit(0.0), F.lit(7.0), F.lit(k)).alias("c")).toPandas().c
        assert got.tolist() == want.tolist()
    got = df.select(binning.cut_edges(F.col("x"), [0.0, 1.5, 2.0, 6.0]).alias("c")).toPandas().c
    want = pd.cut(pd.Series(values), bins=[0.0, 1.5, 2.0, 6.0], labels=False, include_lowest=True)
    assert got.fillna(-1).tolist() == want.fillna(-1).tolist()


def test_constant_and_empty_columns(spark):
    one = spark.createDataFrame([(5.0,)] * 4, "x double")
    assert [(r.bin, r.n) for r in binning.bin_report(one, "x", "fixed_width", 2.0).collect()] == [(0, 4)]
    assert {r.k for r in binning.compare_rules(one, "x", 1.0).collect()} >= {1}
    assert binning.bin_report(one.filter("x > 9"), "x", "sqrt").filter("n > 0").count() == 0


def test_entropy_and_cmi(cells):
    rows = cells.toPandas()

    def h(cols):
        return -sum(n / len(rows) * math.log2(n / len(rows)) for n in Counter(map(tuple, rows[cols].values)).values()) if cols else 0.0

    out = stats.conditional_mutual_information(cells, [("a", "b", ()), ("a", "c", ("b",))]).collect()
    for r in out:
        z = list(r.given)
        assert r.cmi == pytest.approx(h([r.x, *z]) + h([r.y, *z]) - h([r.x, r.y, *z]) - h(z), abs=1e-9)


def test_cpts(cells):
    c = stats.contingency(cells, ["a", "b", "c"])
    for t in (bayes.cpt_mle(c, "b", ["a"]), bayes.cpt_laplace(c, "b", ["a"])):
        assert all(r.s == pytest.approx(1) for r in t.groupBy("a").agg(F.sum("p").alias("s")).collect())
    assert bayes.cpt_laplace(c, "b", ["a"]).count() == 9
    joint = bayes.factorised_joint(c, {("a", "b"), ("b", "c")})
    assert joint.agg(F.sum("p")).first()[0] == pytest.approx(1)


def test_equivalent_graphs_score_alike(cells):
    counts = stats.contingency(cells, ["a", "b", "c"])
    s = bayes.FamilyScores(counts, ["a", "b", "c"])
    chain, back, fork = ({("a", "b"), ("b", "c")}, {("c", "b"), ("b", "a")}, {("b", "a"), ("b", "c")})
    lls = [s.score(d)["ll"] for d in (chain, back, fork)]
    assert max(lls) - min(lls) < 1e-8
    sims = [bayes.similarity(counts, d).first()[0] for d in (chain, back, fork)]
    assert max(sims) - min(sims) < 1e-8


def test_hill_climb_is_a_local_optimum(cells):
    counts = stats.contingency(cells, ["a", "b", "c"])
    s = bayes.FamilyScores(counts, ["a", "b", "c"], alpha=1.0)
    every = {(x, y) for x in "abc" for y in "abc" if x != y}
    found, score = bayes.hill_climb(s, (), every, every)
    assert score == pytest.approx(s.score(found, "abc")["bic"])
    around = [found ^ {e} for e in every]
    assert all(s.score(d, "abc")["bic"] >= score - 1e-9 for d in around if bayes.is_acyclic(d))
    kept, _ = bayes.expand_dag(s, {("c", "a")}, every)
    assert ("c", "a") in kept


def test_sample_follows_the_tables(spark, cells):
    counts = stats.contingency(cells, ["a", "b"])
    out = bayes.ancestral_sample(spark, counts, {("a", "b")}, 4000)
    assert out.count() == 4000
    want = {(r.a, r.b): r.p for r in bayes.cpt_mle(counts, "b", ["a"]).collect()}
    got = Counter((r.a, r.b) for r in out.collect())
    total = Counter()
    for (a, _), n in got.items():
        total[a] += n
    assert set(got) <= set(want)
    assert all(abs(got[k] / total[k[0]] - p) < 0.05 for k, p in want.items())


def test_ks_and_running_totals(spark):
    rng = random.Random(9)
    a, b = [rng.choice([1.0, 2.0, 2.5, 9.0]) for _ in range(70)], [rng.gauss(2, 1) for _ in range(90)]
    df = lambda xs: spark.createDataFrame([(x,) for x in [*xs, None]], "v double")
    want = max(abs(sum(x <= t for x in a) / len(a) - sum(x <= t for x in b) / len(b)) for t in a + b)
    row = stats.ks_statistic(df(a), df(b), "v").first()
    assert (row.ks, row.n_a, row.n_b) == (pytest.approx(want), 70, 90)
    assert stats.ks_p_value(0.0, 10, 10) == 1.0 and stats.ks_p_value(1.0, 50, 50) < 1e-6


def test_percent_rank_matches_pandas(spark):
    rng = random.Random(2)
    rows = [(rng.choice("pq"), rng.choice([None, 1.0, 2.0, 3.5]), i) for i in range(60)]
    got = windows.percent_rank_avg(spark.createDataFrame(rows, "t string, v double, i int"), "v", ["t"], "r").toPandas().sort_values("i")
    want = pd.DataFrame(rows, columns=["t", "v", "i"]).groupby("t").v.rank(pct=True)
    assert all((math.isnan(a) and math.isnan(b)) or a == pytest.approx(b) for a, b in zip(got.r.astype(float), want.astype(float)))


def test_permute_within_keeps_groups(spark, cells):
    out = windows.permute_within(cells, "v", ["a"], "id", 3, "w")
    old, new = defaultdict(list), defaultdict(list)
    for r in out.collect():
        old[r.a].append(r.v)
        new[r.a].append(r.w)
    assert all(sorted(old[k]) == sorted(new[k]) and old[k] != new[k] for k in old)


def test_do_probability_by_hand(spark, cells):
    rows = cells.toPandas()
    out = {(r.b, r.c): (r.p, r.coverage) for r in causal.do_probability(stats.contingency(cells, ["a", "b", "c"]), "b", "c", ["a"]).collect()}
    for (b, c), (p, cover) in out.items():
        want = reach = 0.0
        for _, g in rows.groupby("a"):
            own = g[g.b == b]
            if len(own):
                want += (own.c == c).mean() * len(g) / len(rows)
                reach += len(g) / len(rows)
        assert (p, cover) == (pytest.approx(want), pytest.approx(reach))


def test_adjusted_effect(spark, cells):
    rows = cells.toPandas()
    x = np.column_stack([np.ones(len(rows)), rows.b, rows.a == "y", rows.a == "z"]).astype(float)
    want = np.linalg.lstsq(x, rows.v.to_numpy(), rcond=None)[0][1]
    assert causal.adjusted_effect(cells, "b", "v", ["a"]).first().effect == pytest.approx(want)
    assert causal.adjusted_effect(cells.limit(5), "b", "v", []).first().method == "insufficient_data"


def test_spurious_flags_handle_gaps(spark):
    e = spark.createDataFrame([("t", "a", 0.1), ("t", "b", -5.0), ("t", "c", 9.0)], "target string, feature string, effect double")
    i = spark.createDataFrame([("t", "a", 8.0, 0.9), ("t", "b", -1.0, 0.1), ("t", "d", 2.0, 0.2)], "target string, feature string, sensitivity double, permutation double")
    out = {r.feature: (r.spurious, r.coherent) for r in causal.spurious_flags(e, i).collect()}
    assert out == {"a": (True, True), "b": (False, True), "c": (False, False), "d": (False, False)}


def test_search_takes_the_first_best(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double")
    model = lambda d: d.withColumn("p", F.col("x"))
    o = rescale.Objective((("y", "p"),))
    found, scaled = rescale.greedy_scale_search(df, ["x"], model, o, [1.0, 2.0, 2.0, 3.0])
    assert found == {"x": 2.0} and [r.x for r in scaled.collect()] == [2.0, 4.0, 6.0]
    limited = rescale.Objective((("y", "p"),), "constrained", limits=(0.5,))
    assert rescale.best_of(rescale.search(df, "x", [3.0, 2.1], model, limited)).first().factor == 2.1


def test_augmentation(spark):
    df = spark.createDataFrame([(i, float(i), 0.0 if i % 2 else 3.0, "n") for i in range(20)], "id long, x double, z double, s string")
    out = rescale.augment_interpolate(df, "id", ["x"], 5)
    new = out.filter("id is null").collect()
    assert len(new) == 15 and all(r.s is None and 0 <= r.x <= 19 for r in new)
    noisy = rescale.augment_noise(df, "id", ["x", "z"], exclusive=("x", "z"))
    assert noisy.count() == 40 and noisy.filter("x < 0 or z < 0").count() == 0


def test_recode_and_guards(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, -3.0)], "k string, x double")
    assert [r[0] for r in df.select(columns.recode(F.col("k"), {"a": "z"})).collect()] == ["z", "b", None]
    assert [r[0] for r in df.select(columns.clip_low(F.col("x"))).collect()] == [1.0, None, 0.0]
    with pytest.raises(ValueError):
        columns.require_columns(df, ["nope"])
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xlsx")


def test_logs_round_trip(spark, tmp_path):
    scored = spark.createDataFrame([("7.1", "A -> B, B -> C", 0.5922, -557.23, 1140.46, 1188.74)], "dag_id string, edges string, similarity double, ll double, aic double, bic double")
    logs.dag_lines(scored).coalesce(1).write.text(str(tmp_path / "log"))
    back = logs.read_scored_dags(spark, str(tmp_path / "log")).first()
    assert (back.dag_id, back.bic, [(e.parent, e.child) for e in back.edges]) == ("7.1", 1188.74, [("A", "B"), ("B", "C")])
    (tmp_path / "blocks.log").write_text("DAG 1:\nEdges: [('A', 'B'), ('B', 'C')]\nScore: 5555.5\n\nDAG 2:\nEdges: [('C', 'B')]\n")
    blocks = logs.read_dag_blocks(spark, str(tmp_path / "blocks.log"))
    assert {(r.dag_id, len(r.edges), r.score) for r in blocks.collect()} == {(1, 2, 5555.5), (2, 1, None)}
    assert logs.edge_rows(blocks).count() == 3


def test_tables(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"sample_DAG{i}.csv").write_text(f"x,y\n{i},a\n{i + 5},b\n")
    df = tables.read_numbered(spark, str(tmp_path / "sample_DAG*.csv"), r"DAG(\d+)", "x int, y string")
    assert sorted((r.dag_id, r.x) for r in df.collect()) == [(1, 1), (1, 6), (2, 2), (2, 7)]
    assert tables.extract(df.withColumnRenamed("x", " x "), {"x": "X"}).columns == ["X"]
    assert tables.union_tables(df, df.drop("y"), cols=["x"]).count() == 8


def test_exact_p_values_of_a_small_table_are_dealt_to_tasks(spark):
    pairs = [(5, 7), (30, 12), (64, 64), (1, 1), (90, 41), (3, 200)] * 20
    ks = [round(0.3 * math.lcm(a, b)) / math.lcm(a, b) for a, b in pairs]
    each = [stats.ks_exact_p(k, a, b) for k, (a, b) in zip(ks, pairs)]
    assert list(stats.ks_exact_ps(ks, *zip(*pairs))) == each
    tests = spark.createDataFrame([(k, a, b) for k, (a, b) in zip(ks, pairs)], "ks double, n_a long, n_b long").coalesce(1)
    got = stats.with_p_value(tests).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.p for r in got) == sorted(each) and len({r.task for r in got}) > 1


def test_searches_predict_equal_rows_once(spark):
    rows = spark.range(5000).select((F.col("id") % 7).cast("double").alias("q"), (F.col("id") % 3).cast("double").alias("u"), F.when(F.col("id") % 11 > 0, F.col("id") % 101 * 0.1).alias("y"), (F.col("id") % 13 * 1.0).alias("t"))
    model = lambda df: df.withColumns({"p_y": F.when(F.col("u") < 2, F.col("q") * 2 + F.col("u")), "p_t": F.col("q") + F.col("u")})
    pairs, factors = (("y", "p_y"), ("t", "p_t")), [0.3, 1.0, 1.7]
    for o in [rescale.Objective(pairs, k, (9.0, 4.0), (30.0, 40.0)) for k in ("r2", "mse", "tolerance", "constrained")]:
        for mask in (None, F.col("q") > 2):
            want, got = ({r["i"]: r for r in rescale.search(rows, "q", factors, model, o, mask, reads).collect()} for reads in (None, ["q", "u"]))
            assert all(got[i]["value"] == pytest.approx(want[i]["value"], rel=1e-12) and got[i]["ok"] == want[i]["ok"] for i in range(3)) and len(got) == 3
    met = []
    rescale.search(rows, "q", factors, lambda df: met.append(df.count()) or model(df), o, None, ["q", "u"])
    assert met == [21 * len(factors)]  # 21 kinds of rows
