"""Exact tests, cubes, generators, guide tables, bootstraps and validation against brute force, golden values and each other."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import bayes, binning, causal, cube, generators, models, rescale, stats, validation


@pytest.mark.parametrize("m, n", [(3, 3), (4, 6), (5, 5), (2, 7), (6, 4)])
def test_exact_p_counts_every_order(m, n):
    gaps = []
    for own in combinations(range(m + n), m):
        a = np.isin(np.arange(m + n), own)
        gaps.append(np.abs(np.cumsum(a) / m - np.cumsum(~a) / n).max())
    for d in sorted(set(np.round(gaps, 12))):
        assert stats.ks_exact_p(d, m, n) == pytest.approx(np.mean([g >= d - 1e-9 for g in gaps]), rel=1e-12)


def test_exact_p_golden():
    assert stats.ks_exact_p(0.6, 5, 5) == pytest.approx(90 / 252)  # published tables of Smirnov's statistic
    assert stats.ks_exact_p(1.0, 10, 10) == pytest.approx(2 / math.comb(20, 10))
    n, h = 50, 15  # equal sizes: reflection
    closed = 2 * sum((-1) ** (k - 1) * math.comb(2 * n, n - k * h) for k in range(1, n // h + 1)) / math.comb(2 * n, n)
    assert stats.ks_exact_p(h / n, n, n) == pytest.approx(closed, rel=1e-12)
    assert stats.ks_exact_p(0.0, 4, 9) == 1.0
    assert stats.ks_exact_p(0.05, 3000, 2500) == pytest.approx(stats.ks_p_value(0.05, 3000, 2500), rel=0.1)


def test_two_sample_names_and_methods(spark):
    rows = spark.createDataFrame([(g, float(i * 7 % 11), s) for g in (1, 2, None) for s in (0, 1) for i in range(5 + 20 * (g == 2) + 3 * s)] + [(1, None, 0), (1, float("nan"), 1)], "a int, v double, b int")
    got = {r["a"]: r for r in stats.ks_two_sample(rows.filter("b = 0"), rows.filter("b = 1"), "v", ["a"], exact_up_to=10).collect()}
    assert {k: r["method"] for k, r in got.items()} == {1: "exact", 2: "asymptotic", None: "exact"}
    assert got[None]["p"] == pytest.approx(stats.ks_exact_p(got[None]["ks"], 5, 8)) and got[1]["n_b"] == 9
    out = stats.compare_responses(rows.filter("b = 0"), rows, "v", ["a"], "b").collect()
    assert {r["b"] for r in out} == {0, 1}
    for bad in (lambda: stats.contingency(rows.withColumnRenamed("a", "n"), ["n"]), lambda: stats.relative_frequency(stats.contingency(rows.withColumnRenamed("a", "p"), ["p"]), [])):
        with pytest.raises(ValueError, match="rename"):
            bad()


def holed(spark, k=40):
    """Rows of which a third lacks a, some with NaN."""
    return spark.createDataFrame([(None if i % 3 == 0 else i % 4, "xy"[i % 2], [1.0, 2.0, float("nan"), None][i * i % 4], i % 3) for i in range(k)], "a int, b string, v double, c int")


def test_tables_with_nulls_sum_to_one(spark):
    rows = holed(spark)
    counts = stats.contingency(rows, ["a", "b", "v", "c"])
    saturated = frozenset({("a", "b"), ("a", "c"), ("b", "c")})
    counts3 = stats.contingency(rows, ["a", "b", "c"])
    assert counts.filter("a is null or v is null or isnan(v)").count() == 0
    assert bayes.factorised_joint(counts3, saturated).agg(F.sum("p")).first()[0] == pytest.approx(1)
    assert bayes.similarity(counts3, saturated).first()[0] == pytest.approx(1)
    assert all(r[1] == pytest.approx(1) for r in bayes.cpt_laplace(counts3, "a", ["b"]).groupBy("b").agg(F.sum("p")).collect())
    assert all(r[1] == pytest.approx(1) for r in causal.do_probability(counts3, "c", "b", ["a"]).groupBy("c").agg(F.sum("p") / F.first("coverage")).collect())


def test_cube_scores_as_one_graph_at_a_time(spark):
    rows = holed(spark, 90).withColumn("d", F.col("c") * 2 + (F.col("b") == "x").cast("int"))
    cols = ["a", "b", "c", "d"]
    whole = rows.na.drop(subset=cols)
    dags = dict(enumerate(d for t in bayes.node_combinations(cols).values() for d in bayes.enumerate_dags(t)))
    assert len(dags) == 72
    got = {r["dag_id"]: r for r in cube.score_trios(rows, dags, cols).collect()}
    for trio in bayes.node_combinations(cols).values():
        own = {k: d for k, d in dags.items() if {x for e in d for x in e} == set(trio)}
        for r in bayes.score_dags(whole, own, list(trio)).collect():
            assert got[r["dag_id"]]["edges"] == r["edges"] and got[r["dag_id"]]["k"] == r["k"]
            for c in ("ll", "aic", "bic", "similarity"):
                assert got[r["dag_id"]][c] == pytest.approx(r[c], abs=1e-9)
    assert cube.score_trios(rows.limit(0), dags, cols).count() == 0
    with pytest.raises(ValueError, match="three columns"):
        cube.score_trios(rows, {1: frozenset({("a", "b")})}, cols)


def test_guide_tables_draw_the_table(spark):
    table = spark.createDataFrame([("g", "a", 1), ("g", "b", 0), ("g", "c", 7), ("g", "d", 2), ("h", "z", 5)], "g string, state string, n long")
    guide = generators.guide_table(table, ["g"])
    assert guide.filter("g = 'h'").select("state", "lo", "hi", "slot").collect() == [("z", 0.0, 1.0, 0)]
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "g").otherwise("none").alias("g"), "id", generators.hash_uniform(F.col("id")).alias("u"))
    drawn = generators.draw_states(rows, guide, ["g"], "u", "state")
    share = {r["state"]: r["count"] / 10_000 for r in drawn.groupBy("state").count().collect()}
    assert share.keys() == {"a", "c", "d"} and all(abs(share[k] - p) < 0.02 for k, p in (("a", 0.1), ("c", 0.7), ("d", 0.2)))


def test_a_million_states(spark):
    table = spark.range(1_000_000).select(F.lit(1).alias("g"), F.col("id").alias("state"), (F.col("id") % 5 + 1).alias("n"))
    guide = generators.guide_table(table, ["g"])
    assert 1_000_000 <= guide.count() <= 2_000_000
    rows = spark.range(3000).select(F.lit(1).alias("g"), generators.hash_uniform(F.col("id")).alias("u"))
    got = generators.draw_states(rows, guide, ["g"], "u", "s").collect()
    upto = np.cumsum(np.arange(1_000_000) % 5 + 1)
    assert len(got) == 3000 and all(r["s"] == np.searchsorted(upto, r["u"] * upto[-1], side="right") for r in got)


def test_generators_are_sampled_as_one_by_one(spark):
    rows = spark.createDataFrame([(a, "xyz"[(a + i) % 3], float(i % 2)) for a in range(4) for i in range(a + 2)] + [(None, "x", 1.0)], "a int, b string, c double")
    counts = stats.contingency(rows, ["a", "b", "c"])
    dags = {7: frozenset({("a", "b"), ("b", "c")}), 9: frozenset({("b", "a")})}
    out = generators.sample_generators(counts, dags, 500, 2)
    assert out.dtypes == [("dag_id", "int"), ("iteration", "int"), ("row", "bigint"), ("a", "int"), ("b", "string"), ("c", "double")]
    assert {(r["dag_id"], r["iteration"]): r["count"] for r in out.groupBy("dag_id", "iteration").count().collect()} == {(7, 0): 500, (7, 1): 500, (9, 0): 500, (9, 1): 500}
    assert out.filter("dag_id = 9 and c is not null").count() == 0
    seen = {(r["a"], r["b"]) for r in counts.collect()}
    assert {(r["a"], r["b"]) for r in out.select("a", "b").distinct().collect()} <= seen
    alone = bayes.ancestral_sample(spark, counts, dags[7], 500).select("a", "b", "c").collect()  # the first graph's first iteration has the same keys
    assert sorted(alone, key=str) == sorted(out.filter("dag_id = 7 and iteration = 0").select("a", "b", "c").collect(), key=str)
    meets = stats.contingency(spark.createDataFrame([(0, 0, 0), (1, 1, 1)], "a int, b int, c int"), ["a", "b", "c"])
    some = generators.sample_generators(meets, {1: frozenset({("a", "c"), ("b", "c")})}, 400)
    assert 100 < some.count() < 300 and some.filter("a <> b").count() == 0  # parents that never met are rejected


def test_winners_are_counted_by_iteration(spark):
    metrics = spark.createDataFrame([(k, t, float((k * 3 + t) % 5), float(k)) for k in range(1, 6) for t in range(4)] + [(6, 0, None, None)], "dag_id int, iteration int, mean_mae double, mean_ks double")
    times = {}
    for t in range(4):
        own = [(k, (k * 3 + t) % 5, k) for k in range(1, 6)]
        scaled = sorted((((m - min(x[1] for x in own)) / 4 + (s - 1) / 4), k) for k, m, s in own)
        for _, k in scaled[:2]:
            times[k] = times.get(k, 0) + 1
    got = generators.generator_winners(metrics.na.drop(), best=2, k=3).collect()
    assert [(r["dag_id"], r["times"]) for r in got] == sorted(times.items(), key=lambda kv: (-kv[1], kv[0]))[:3]


def test_second_estimator(spark):
    rng = np.random.default_rng(5)
    z, noise = rng.integers(0, 4, 900), rng.normal(size=900)
    x = rng.normal(size=900) + z
    data = [(i, float(x[i]), "stuv"[z[i]], "ab"[int(x[i] > z[i])], float(2 * x[i] + 3 * z[i] + noise[i])) for i in range(900)]
    rows = spark.createDataFrame([*data, (900, None, "s", None, 1.0), (901, 1.0, "w", "a", float("nan"))], "key long, x double, z string, d string, y double")
    r = causal.stratified_effect(rows, "x", "y", ["z"], "key", 60).first()
    assert r["effect"] == pytest.approx(causal.adjusted_effect(rows.na.drop(), "x", "y", ["z"]).first()["effect"], abs=1e-9)
    assert r["low"] < 2 < r["high"] and r["low"] < r["effect"] < r["high"] and 0.2 < r["se"] * math.sqrt(900) < 5 and (r["n"], r["coverage"]) == (900, 1)
    d = causal.stratified_effect(rows, "d", "y", ["z"], "key", 20).first()
    want = sum(sum(1 for v in data if v[2] == s) * (np.mean([v[4] for v in data if v[2:4] == (s, "b")]) - np.mean([v[4] for v in data if v[2:4] == (s, "a")])) for s in "stuv") / 900
    assert d["effect"] == pytest.approx(want, abs=1e-9) and d["low"] < d["effect"] < d["high"]
    lone = causal.stratified_effect(rows.filter("key < 900").unionByName(spark.createDataFrame([(2000, 5.0, "alone", "a", 1.0)], rows.schema)), "d", "y", ["z"], "key", 5).first()
    assert lone["effect"] == pytest.approx(want, abs=1e-9) and lone["coverage"] == pytest.approx(900 / 901)
    empty = causal.stratified_effect(rows.limit(0), "x", "y", ["z"], "key", 5).first()
    assert (empty["effect"], empty["n"]) == (None, 0)


def test_importance_and_sensitivity_of_all_features_at_once(spark):
    rows = spark.range(400).select(F.col("id").alias("key"), (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") % 7).alias("k"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("g"), F.lit(1.0).alias("idle"))
    rows = rows.withColumns({"y": F.col("x") * 2 + F.col("k"), "t": F.col("k") * 1.0})
    predict = lambda df: df.withColumns({"p_y": F.col("x") * 2 + F.col("k") + F.when(F.col("g") == "a", 3.0).otherwise(0.0), "p_t": F.col("k") * 1.0})
    given = {"x": ["g"], "k": [], "g": ["k"], "idle": []}
    got = {(r["target"], r["feature"]): r for r in validation.importances(rows, predict, ["y", "t"], given, "key", 3).collect()}
    assert len(got) == 8 and got["y", "idle"]["permutation"] == pytest.approx(0) and got["t", "x"]["permutation"] == pytest.approx(0)
    assert got["t", "k"]["permutation"] > 1 and got["y", "x"]["permutation"] > 1
    one = models.permutation_importance(rows, predict, "t", "k", [], "key", 3).first()
    assert got["t", "k"]["base_r2"] == pytest.approx(one["base_r2"]) and one["importance"] == pytest.approx(got["t", "k"]["permutation"], rel=0.2)
    moved = {(r["target"], r["feature"]): r["sensitivity"] for r in validation.sensitivities(rows, predict, ["y", "t"], list(given)).collect()}
    a = rows.filter("g = 'a'").count() / 400
    assert moved == pytest.approx({("y", "x"): 2, ("t", "x"): 0, ("y", "k"): 1, ("t", "k"): 1, ("y", "g"): 3 * (1 - a) - 3 * a, ("t", "g"): 0, ("y", "idle"): 0, ("t", "idle"): 0}, abs=1e-9)
    out = {(r["target"], r["feature"]): r for r in validation.validate(rows, {("g", "x"), ("x", "y"), ("g", "y"), ("k", "y")}, ["y", "t"], ["x", "k", "g"], predict, "key", 2).collect()}
    assert out["y", "x"]["given"] == "g" and out["y", "x"]["effect"] == pytest.approx(2, abs=0.05) and out["y", "x"]["coherent"]
    assert out["t", "x"]["given"] is None and out["t", "x"]["role"] == "unconnected"


def test_interpolation_keeps_pairs_exclusive_and_values_above_low(spark):
    rows = spark.createDataFrame([(i, float(i % 3) - 0.5, float((i + 1) % 2 * 4), None if i == 4 else -float(i)) for i in range(60)], "key long, a double, b double, c double")
    new = rescale.augment_interpolate(rows, "key", ["a", "b", "c"], shift=None, exclusive=("a", "b")).filter("key is null").collect()
    assert len(new) == 60 and all(not (r["a"] > 0 and r["b"] > 0) and r["a"] >= 0 and r["b"] >= 0 for r in new)
    assert sum(r["c"] is None for r in new) == 2 and {r["c"] for r in new} <= {0.0, None}
    free = rescale.augment_interpolate(rows, "key", ["a", "b", "c"], shift=None, low=None).filter("key is null").collect()
    assert min(r["c"] for r in free if r["c"] is not None) < -1 and any(r["a"] > 0 and r["b"] > 0 for r in free)


def test_first_seen_codes_of_many_values(spark):
    rows = spark.range(60_000).select((F.col("id") * 7919 % 20_011).alias("v"), (60_000 - F.col("id")).alias("at")).unionByName(spark.createDataFrame([(None, 0)], "v long, at long"))
    got = {r["v"]: (r["code"], r["first"]) for r in binning.first_seen_codes(rows, "v", "at").collect()}
    first = {}
    for i in range(60_000):
        first[i * 7919 % 20_011] = 60_000 - i
    assert got == {v: (k, f) for k, (f, v) in enumerate(sorted((f, v) for v, f in first.items()))}


def test_importances_of_merged_rows_and_of_covariates_by_target(spark):
    rows = spark.range(300).select(F.col("id").alias("key"), (F.col("id") * 37 % 11).cast("double").alias("x"), (F.col("id") % 7).alias("k"), F.when(F.col("id") % 5 > 0, "a").alias("g"))
    rows = rows.withColumns({"y": F.col("x") * 2 + F.col("k") + F.col("key") % 3, "t": F.col("k") * 1.5 + F.col("key") % 2})
    predict = lambda df: df.withColumns({"p_y": F.col("x") * 2 + F.col("k"), "p_t": F.col("k") * 1.5 + F.when(F.col("g").isNull(), 1.0).otherwise(0.0)})
    given = {("y", "x"): ["g"], ("y", "k"): [], ("t", "x"): [], ("t", "k"): ["g"]}
    one, two = ({(r["target"], r["feature"]): (r["permutation"], r["base_r2"]) for r in validation.importances(rows, predict, ["y", "t"], given, "key", 2, reads=reads).collect()} for reads in (None, ["x", "k", "g"]))
    assert set(one) == set(given) and all(one[k] == pytest.approx(two[k], rel=1e-9, abs=1e-12) for k in given)


def test_effects_of_equal_rows_are_their_numbers_times_ones(spark, monkeypatch):
    rows = spark.range(900).selectExpr("id AS key", "CAST(id % 7 AS double) x", "CASE WHEN id % 3 = 0 THEN 'u' WHEN id % 3 = 1 THEN 'v' END k", "CAST(id % 5 AS double) z", "id % 7 * 2.0 + id % 5 + id % 11 AS y", "CASE WHEN id % 13 = 0 THEN NULL WHEN id % 17 = 0 THEN double('nan') ELSE id % 7 - id % 4 * 0.5D END AS t")
    dag = frozenset({("z", "x"), ("z", "y"), ("x", "y"), ("k", "t"), ("x", "t")})
    predict = lambda d: d.withColumns({"p_y": F.col("x") * 2, "p_t": F.col("x") - F.when(F.col("k") == "u", 1.0).otherwise(0.0)})
    met, effect = [], validation.adjusted_effect
    monkeypatch.setattr(validation, "adjusted_effect", lambda d, *args, **more: met.append(d.count()) or effect(d, *args, **more))
    for t, given in (("y", {"x": ["z"], "k": []}), ("t", {"x": ["z"], "k": ["x"]})):
        for f, z in given.items():
            monkeypatch.setattr(validation, "minimal_backdoor_set", lambda *a, z=z: z)
            kept = rows.filter("NOT isnan(y)") if t == "y" else rows.withColumn("y", F.lit(0.0))
            one, two = (validation.validate(kept.withColumn("y", F.col("y").cast("double")), dag, [t], [f], predict, "key", 1, reads=reads).first() for reads in (None, ["x", "k", "z"]))
            assert (one["effect"], one["method"]) == (pytest.approx(two["effect"]), two["method"]) and one["effect"] is not None
    assert set(met) == {900, rows.select("x", "k", "z").distinct().count()}
    with pytest.raises(ValueError):
        effect(rows.withColumn("n", F.lit(2)), "x", "k", [], weight="n")
