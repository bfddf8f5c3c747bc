"""Learnt models, importance and calibration against sklearn-free brute force: trees that must split at one place, refits by hand, numpy solutions."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from causeway.functions import scratch, windows
from causeway.operators import bayes, causal, models, rescale, stats


@pytest.fixture(scope="module")
def steps(spark):
    """y is a step of x, t one of the category; both without noise, so trees must find them."""
    rng = random.Random(3)
    rows = [(i, x := rng.random() * 10, c := rng.choice("abc"), rng.random(), 5.0 if x > 4 else 1.0, {"a": 0.0, "b": 2.0, "c": 7.0}[c]) for i in range(600)]
    return spark.createDataFrame(rows, "key long, x double, c string, noise double, y double, t double")


FEATURES = ["x", "c", "noise"]


def test_encoder_makes_sorted_dummies(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("it's", 3.0), ("new", 4.0)], "c string, x double")
    stages = models.encoder(df.filter("c <> 'new'"), ["c", "x"])
    out = Pipeline(stages=stages).fit(df).transform(df)
    assert {r.c: tuple(r.features) for r in out.collect()} == {"a": (0, 0, 2), "b": (1, 0, 1), "it's": (0, 1, 3), "new": (0, 0, 4)}
    strict = Pipeline(stages=models.encoder(df.filter("c <> 'new'"), ["c"], unknown="error")).fit(df)
    with pytest.raises(Exception, match="unknown value of c"):
        strict.transform(df).collect()


def test_nominal_columns_have_a_bound(spark):
    from causeway.functions.columns import nominal_values

    df = spark.createDataFrame([(str(i),) for i in range(30)] + [(None,)], "c string")
    assert nominal_values(df, "c") == sorted(str(i) for i in range(30))
    with pytest.raises(ValueError, match="more than 20"):
        nominal_values(df, "c", 20)


def test_forest_finds_steps(steps):
    model = models.forest(steps, FEATURES, "y", numTrees=1, maxDepth=2, subsamplingRate=1.0, featureSubsetStrategy="all", bootstrap=False, maxBins=256)
    near = steps.filter("abs(x - 4) > 0.1")
    assert model.transform(near).filter("abs(p_y - y) > 1e-9").count() == 0
    assert model.stages[-1].featureImportances[0] == pytest.approx(1.0)


def test_boosting_and_grid_search(steps):
    fitted = models.boosted(steps, FEATURES, "t", maxIter=20, maxDepth=3)
    assert fitted.transform(steps).agg(stats.r2(F.col("t"), F.col("p_t")).alias("r")).first().r > 0.999
    best, mse = models.grid_search(steps, FEATURES, "y", {"maxDepth": [1, 3], "numTrees": [3], "featureSubsetStrategy": ["all"]}, folds=3)
    assert best.stages[-1].getOrDefault("maxDepth") == [1, 3][int(np.argmin(mse))]
    assert len(mse) == 2 and min(mse) == pytest.approx(best.transform(steps).agg(stats.mse(F.col("y"), F.col("p_y"))).first()[0], abs=0.2)


def test_split_is_repeatable_and_whole(steps):
    a, b = models.split(steps, "key", 5)
    again, _ = models.split(steps.repartition(7), "key", 5)
    keys = lambda d: {r.key for r in d.select("key").collect()}
    assert keys(a) | keys(b) == set(range(600)) and not keys(a) & keys(b) and keys(a) == keys(again)
    assert 0.74 < len(keys(a)) / 600 < 0.86 and keys(models.split(steps, "key", 6)[0]) != keys(a)


def test_seed_sweep_keeps_what_improves_both(steps):
    scores = {1: (0.5, 0.9), 2: (0.6, 0.8), 3: (0.7, 0.95), 4: (0.9, 0.94)}

    class Fake:
        def __init__(self, seed):
            self.seed = seed

        def transform(self, df):
            kind = 0 if df.count() != 60 else 1
            r = scores[self.seed][kind]
            mean = df.agg(F.avg("y")).first()[0]
            return df.withColumn("p_y", F.col("y") + (F.col("y") - mean) * (1 - r) ** 0.5)

    kept, best = models.seed_sweep(steps, "key", "y", lambda train, s: Fake(s), steps.limit(60), [1, 2, 3, 4])
    assert kept.seed == best["seed"] == 3 and best["validation"] == pytest.approx(0.95, abs=1e-6) and best["train"] == pytest.approx(0.7, abs=1e-6)


@pytest.fixture(scope="module")
def refined(steps):
    return models.fit_refined(steps, FEATURES, ("y", "t"), rounds=2, boosting={"maxIter": 3, "maxDepth": 2}, numTrees=3, maxDepth=3)


def by_hand(df, model, scales=None):
    """The rounds, one model at a time, on collected columns."""
    a, b = model.targets
    rows = df
    p = {}
    for t, m in zip(model.targets, model.first):
        p[t] = {r.key: r[f"p_{t}"] for r in m.transform(rows).collect()}
    for _ in range(model.rounds):
        for t, o, m in ((a, b, model.second[0]), (b, a, model.second[1])):
            seen = df.sparkSession.createDataFrame(list(p[o].items()), f"key long, {o} double")
            col, f = (scales or {}).get(t, (None, 1.0))
            base = df.drop(a, b)
            base = base.withColumn(col, F.col(col) * f) if col else base
            p[t] = {r.key: r[f"p_{t}"] for r in m.transform(base.join(seen, "key")).collect()}
    return p


def test_refined_model_is_its_rounds(spark, steps, refined, tmp_path):
    part = steps.filter("key < 80")
    want = by_hand(part, refined)
    out = refined.transform(part)
    got = out.collect()
    assert all(r.p_y == pytest.approx(want["y"][r.key]) and r.p_t == pytest.approx(want["t"][r.key]) for r in got) and len(got) == 80
    assert {"y", "t"} <= set(out.columns) and "y" not in refined.transform(part.drop("y", "t")).columns
    refined.save(str(tmp_path / "m"))
    back = models.RefinedModel.load(str(tmp_path / "m"), ("y", "t"), 2).transform(part)
    assert {r.key: r.p_y for r in back.collect()} == {r.key: r.p_y for r in got}
    assert PipelineModel([refined]).transform(part).count() == 80  # a stage like others
    alone = models.RefinedModel(refined.first, refined.second, refined.targets, 0).transform(part)
    assert {r.key: r.p_y for r in alone.collect()} == {r.key: r.p_y for r in refined.first[0].transform(part).collect()}


def test_separate_scales(steps, refined):
    part = steps.filter("key < 60")
    want = by_hand(part, refined, {"y": ("x", 0.5)})
    got = models.separate_scales(part, refined, {"y": ("x", 0.5)}).collect()
    assert all(r.p_y == pytest.approx(want["y"][r.key]) and r.p_t == pytest.approx(want["t"][r.key]) for r in got) and len(got) == 60


def test_permutation_importance(steps):
    predict = lambda df: df.withColumn("p_y", F.when(F.col("x") > 4, 5.0).otherwise(1.0))
    row = models.permutation_importance(steps, predict, "y", "x", [], "key", repeats=4).first()
    share = steps.filter("x > 4").count() / 600
    # a random partner disagrees with probability 2 p (1 - p), and R2 falls by twice that over the variance's p (1 - p)
    assert row.base_r2 == pytest.approx(1.0) and row.importance == pytest.approx(2.0, abs=0.35) and 0.3 < share < 0.9
    assert models.permutation_importance(steps, predict, "y", "noise", [], "key", repeats=2).first().importance == pytest.approx(0.0)
    within = steps.withColumn("side", F.col("x") > 4)
    assert models.permutation_importance(within, predict, "y", "x", ["side"], "key", repeats=2).first().importance == pytest.approx(0.0)


def test_sensitivity(steps):
    predict = lambda df: df.withColumn("p_y", F.col("x") * 3 + F.when(F.col("c") == "a", 10.0).otherwise(0.0))
    assert models.sensitivity(steps, predict, "y", "x", "key", delta=0.5).first()[0] == pytest.approx(1.5)
    n_a = steps.filter("c = 'a'").count()
    assert models.sensitivity(steps, predict, "y", "c", "key", swap=("a", "b")).first()[0] == pytest.approx(10 * ((600 - n_a) - n_a) / 600)


def test_polynomial_calibration_is_least_squares(steps):
    df = steps.withColumn("p", F.col("x") / 10).withColumn("z", F.col("p") * F.col("p") * 3 - F.col("p") + 0.1 * F.col("noise"))
    fitted = rescale.calibrate_polynomial(df, "p", "z", 3)
    rows = fitted.apply(df, "p", "out").select("p", "z", "out").collect()
    p, z = np.array([r.p for r in rows]), np.array([r.z for r in rows])
    want = np.polyval(np.polyfit(p, z, 3), p)
    assert np.allclose([r.out for r in rows], want, atol=1e-6)


def test_isotonic_calibration_pools(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    ys = [1.0, 3.0, 2.0, 4.0, 3.5, 6.0]
    df = spark.createDataFrame(list(zip(xs, ys)), "p double, z double")
    out = rescale.calibrate_isotonic(df, "p", "z").apply(df, "p", "o").orderBy("p").collect()
    assert [r.o for r in out] == pytest.approx([1.0, 2.5, 2.5, 3.75, 3.75, 6.0])


def test_logit_effect(spark):
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=3000), rng.normal(size=3000)
    y = rng.random(3000) < 1 / (1 + np.exp(-(0.3 + 1.2 * x - 0.7 * z)))
    df = spark.createDataFrame([(float(a), float(b), "yes" if c else "no") for a, b, c in zip(x, z, y)], "x double, z double, y string")
    design, w = np.column_stack([np.ones(3000), x, z]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ w))
        w += np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design, design.T @ (y - p))
    row = causal.adjusted_effect(df, "x", "y", ["z"]).first()
    assert row.method == "logit" and row.effect == pytest.approx(w[1], rel=1e-4)
    three = df.withColumn("y", F.when(F.col("x") > 1, "maybe").otherwise(F.col("y")))
    assert causal.adjusted_effect(three, "x", "y", ["z"]).first().method == "linear_probability"


@pytest.mark.parametrize("most", [200_000, 0])
def test_exact_percentiles(spark, monkeypatch, most):
    monkeypatch.setattr(windows, "DISTINCT", most)
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, round(rng.gauss(0, 1), 2), 1e9])) for _ in range(400)] + [("empty", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    ps = [0.0, 0.05, 0.25, 0.5, 0.731, 1.0]
    got = {r.g: r.q for r in windows.exact_percentiles(df, "v", ps, ["g"]).collect()}
    for g in ("a", "b", None, "one"):
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], ps))
    assert got.get("empty") is None
    assert windows.exact_percentiles(df, "v", ps).first().q == pytest.approx(np.quantile([v for _, v in rows if v is not None], ps))
    assert windows.exact_percentiles(df.limit(0), "v", ps, ["g"]).count() == 0


def test_running_totals_and_positions(spark):
    rng = random.Random(8)
    rows = [(g, float(v), rng.randrange(5)) for g in ("a", None) for v in rng.sample(range(10**6), 150)]
    df = spark.createDataFrame(rows, "g string, v double, n long").repartition(6)
    for r in windows.running_totals(df, "v", ["n"], ["g"]).collect():
        own = [(v, n) for g, v, n in rows if g == r.g]
        assert (r.cum_n, r.all_n) == (sum(n for v, n in own if v <= r.v), sum(n for _, n in own))
    whole = windows.running_totals(df.drop("g"), "v", ["n"]).orderBy("v").collect()
    assert [r.cum_n for r in whole] == np.cumsum([n for _, _, n in sorted(rows, key=lambda r: r[1])]).tolist()
    placed = windows.positions(df, ["g"], [F.col("v")], "at").collect()
    assert all(r["at"] == sum(g == r.g and v <= r.v for g, v, _ in rows) for r in placed) and len(placed) == 300


def test_a_permutation_of_the_whole_table(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 2)
    out = windows.permute_within(df, "v", [], "id", 3, "w").collect()
    assert sorted(r.w for r in out) == [2 * i for i in range(500)] and sum(r.w == r.v for r in out) < 20
    assert {r.id: r.w for r in windows.permute_within(df.repartition(3), "v", [], "id", 3, "w").collect()} == {r.id: r.w for r in out}


def test_small_broadcasts_only_few_rows(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(scratch.small(spark.range(10), 10)) and not hinted(scratch.small(spark.range(11), 10))


def test_rejected_samples_are_drawn_again(spark):
    # b's parents a and c are never 1 together, so a quarter of the draws must be rejected
    cells = [(0, 0, 0, 25), (0, 1, 1, 25), (1, 0, 1, 50)]
    counts = spark.createDataFrame(cells, "a int, c int, b int, n long")
    out = bayes.ancestral_sample(spark, counts, frozenset({("a", "b"), ("c", "b")}), 400).collect()
    assert len(out) == 400 == len({r.row for r in out})
    assert {(r.a, r.c, r.b) for r in out} == {(0, 0, 0), (0, 1, 1), (1, 0, 1)}
    assert max(r.row for r in out) >= 400


def test_generator_rankings_and_winners(spark):
    metrics = spark.createDataFrame([(1, "s", 1.0, 0.9), (1, "p", 3.0, 0.9), (2, "s", 4.0, 0.1), (2, "p", 4.0, 0.1), (3, "s", 3.0, 0.2), (3, "p", 3.0, 0.2)], "dag_id int, outcome string, mae double, ks double")
    got = {(r.ranking, r["rank"]): r.dag_id for r in bayes.generator_rankings(metrics, "dag_id", 2).collect()}
    assert got == {("mean_mae", 1): 1, ("mean_mae", 2): 3, ("mean_ks", 1): 2, ("mean_ks", 2): 3, ("tradeoff", 1): 3, ("tradeoff", 2): 1}
    edges = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "a", "c")], "dag_id int, parent string, child string")
    best = bayes.winner_edges(edges, spark.createDataFrame([(3,), (1,), (3,), (2,)], "dag_id int"), 2)
    assert {r.dag_id for r in best.collect()} == {1, 3}


def test_random_pairs(spark):
    df = spark.createDataFrame([(i, float(i * i), "x") for i in range(200)], "k long, v double, name string")
    out = rescale.augment_interpolate(df, "k", ["v"], shift=None)
    new = out.filter("name is null").collect()
    assert len(new) == 200 and all(0 <= r.v <= 199**2 and r.k is None for r in new)
    again = rescale.augment_interpolate(df.repartition(7), "k", ["v"], shift=None).filter("name is null").collect()
    assert sorted(r.v for r in new) == sorted(r.v for r in again)
    assert len({r.v for r in new}) > 190


def test_importance_in_buckets_gives_the_textbook_order_and_leaves_no_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(windows, "BUCKET", 16)
    df = spark.range(900).select(F.col("id").alias("key"), (F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 9 < 8, "big").alias("g"), (F.col("id") * 31 % 10).cast("double").alias("y"))
    got = {r.key: r.w for r in windows.permute_within(df, "x", ["g"], "key", 3, "w").collect()}
    rows = df.withColumn("h", F.xxhash64("key", F.lit(3))).collect()
    for g in ("big", None):
        own = sorted((r for r in rows if r.g == g), key=lambda r: r.key)
        assert [got[r.key] for r in own] == [r.x for r in sorted(own, key=lambda r: (r.h, r.key))]
    made = []
    monkeypatch.setattr(scratch, "scratch_path", lambda _, name: made.append(f"file://{tmp_path}/{len(made)}/{name}") or scratch.MADE.append(made[-1]) or made[-1])
    monkeypatch.setattr(models, "AT_ONCE", 1000)  # a job a repeat
    predict = lambda d: d.withColumn("p_y", F.col("x") * 0.5 + F.when(F.col("g").isNull(), 1.0).otherwise(0.0))
    each = models.permutation_importance(df, predict, "y", "x", ["g"], "key", 3).first()
    once = models.permutation_importance(df, predict, "y", "x", ["g"], "key", 3, reads=["x", "g"]).first()
    assert (each.importance, each.base_r2) == pytest.approx((once.importance, once.base_r2)) and made and not list(tmp_path.rglob("*.parquet"))


def repeated(spark, copies=6):
    rows = spark.range(400).selectExpr("CAST(id % 9 AS double) a", "CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 'u' ELSE 'v' END c", "CAST(id % 13 AS double) b")
    rows = rows.crossJoin(spark.range(copies).withColumnRenamed("id", "i")).filter("(a * 7 + b * 3 + i) % 5 <> 0")  # as many copies as it falls out
    return rows.selectExpr("a", "b", "c", "a * 2 + CASE WHEN c = 'u' AND b > 5 THEN 9.0 ELSE 0.0 END + i * (b - 6) / 7 AS y")


def test_boosted_trees_of_equal_rows_meet_them_once(spark, monkeypatch):
    df = repeated(spark).repartition(5)
    cells = models.merged_rows(df, ["a", "b", "c"], "y")
    want = {(r.a, r.b, r.c): (r.y, r.n) for r in df.groupBy("a", "b", "c").agg(F.avg("y").alias("y"), F.count("*").alias("n")).collect()}
    got = {(r.a, r.b, r.c): (r.y, r.n_) for r in cells.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and 2 * len(got) <= df.count()
    merged = models.boosted(df, ["a", "b", "c"], "y", maxIter=6, maxDepth=4)
    monkeypatch.setattr(models, "LINEAR", set())
    apart = models.boosted(df, ["a", "b", "c"], "y", maxIter=6, maxDepth=4)
    assert merged.stages[-1].getWeightCol() == "n_" and not apart.stages[-1].isSet("weightCol")
    both = merged.transform(df).select("a", "b", "c", F.col("p_y").alias("p")).distinct().join(apart.transform(df).select("a", "b", "c", "p_y").distinct().withColumnsRenamed({"a": "a_", "b": "b_", "c": "c_"}), F.expr("a = a_ AND b = b_ AND c <=> c_"))
    assert both.count() == len(want) and both.filter("abs(p - p_y) > 1e-9").count() == 0


def test_what_boosted_trees_may_not_merge(spark, steps):
    df = repeated(spark)
    assert models.merged_rows(steps, FEATURES, "y") is None  # a feature is continuous
    assert not models.boosted(df, ["a", "b"], "y", maxIter=1, minInstancesPerNode=20).stages[-1].isSet("weightCol")  # counts rows
    holes = df.withColumn("y", F.when((F.col("a") != 3) | (F.rand(1) < 0.8), F.col("y")))
    with pytest.raises(Exception, match="(?i)null"):
        models.boosted(holes, ["a", "b"], "y", maxIter=1)  # as it does without merging
    with pytest.raises(ValueError):
        models.merged_rows(df.withColumnRenamed("a", "n_"), ["n_"], "y")


def test_a_learners_partitions_are_bounded(spark, monkeypatch):
    df = repeated(spark).coalesce(1)
    assert models.in_parts(df) is df and models.in_parts(df.limit(0)).count() == 0
    monkeypatch.setattr(models, "PART", 100)
    kept, seen = models.in_parts, []
    monkeypatch.setattr(models, "in_parts", lambda d: seen.append(kept(d)) or seen[-1])
    for fit, bound in ((models.forest, df.count()), (models.boosted, df.select("a", "b").distinct().count())):
        fit(df, ["a", "b"], "y", maxDepth=2, **({"numTrees": 2} if fit is models.forest else {"maxIter": 1}))
        parts = [r["count"] for r in seen[-1].groupBy(F.spark_partition_id()).count().collect()]
        assert sum(parts) == bound and max(parts) <= 130  # dealt in turn, from any number of partitions
    assert set(seen[0].columns) == {"a", "b", "y"}


def test_forests_draw_by_key_and_meet_equal_rows_once(spark, monkeypatch):
    df = repeated(spark).withColumn("key", F.monotonically_increasing_id()).withColumn("z", F.col("y") - F.col("b")).localCheckpoint()
    rows = models.drawn_rows(df, ["a", "b", "c"], ["y", "z"], "key", 3, 5)
    weights = [causal.poisson_weight(F.shiftrightunsigned(F.xxhash64("key", F.lit(5), F.lit(i)), 11) / F.lit(2.0**53)).alias(f"w{i}") for i in range(3)]
    brute = {}
    for r in df.select("a", "b", "c", "y", "z", *weights).collect():
        for i in range(3):
            one = brute.setdefault((r.a, r.b, r.c, i), [0, 0.0, 0.0])
            one[0], one[1], one[2] = one[0] + r[f"w{i}"], one[1] + r[f"w{i}"] * r.y, one[2] + r[f"w{i}"] * r.z
    assert 0.95 < sum(w for w, _, _ in brute.values()) / 3 / df.count() < 1.05 and 2 * rows.count() <= 3 * df.count()
    drawn = {(r.a, r.b, r.c, r.tree_): (r.w_, r.y0_, r.y1_) for r in rows.collect()}
    assert drawn.keys() == {k for k, (w, _, _) in brute.items() if w}
    assert all(v == pytest.approx((brute[k][0], brute[k][1] / brute[k][0], brute[k][2] / brute[k][0])) for k, v in drawn.items())
    met, fit = [], models.RandomForestRegressor.fit
    monkeypatch.setattr(models.RandomForestRegressor, "fit", lambda self, d: met.append(d.count()) or fit(self, d))
    settings = {"numTrees": 3, "maxDepth": 12, "featureSubsetStrategy": "all", "maxBins": 64}
    model = models.forest(df, ["a", "b", "c"], "y", 5, key="key", **settings)
    assert len(met) == 3 and 2 * max(met) <= df.count()
    got = {(r.a, r.b, r.c): r.p_y for r in model.transform(df).select("a", "b", "c", "p_y").distinct().collect()}
    trees = {}  # of full depth: a kind that all trees drew has their means
    for (a, b, c, i), (w, y, _) in brute.items():
        trees.setdefault((a, b, c if c == "v" else None), {}).setdefault(i, [0, 0.0])  # null has the dummies of the first value
        trees[a, b, c if c == "v" else None][i][0] += w
        trees[a, b, c if c == "v" else None][i][1] += y
    whole = {k: sum(y / w for w, y in v.values()) / 3 for k, v in trees.items() if all(w for w, _ in v.values())}
    assert len(whole) > 50 and all(got[k] == pytest.approx(v) for k, v in ((key, whole.get((key[0], key[1], key[2] if key[2] == "v" else None))) for key in got) if v is not None)
    assert "p_y_0_" not in model.transform(df).columns
    refined = models.fit_refined(df, ["a", "b", "c"], ("y", "z"), 1, 5, boosting={"maxIter": 1}, key="key", **settings)
    assert {(r.a, r.b, r.c): r.p_y for r in refined.first[0].transform(df).select("a", "b", "c", "p_y").distinct().collect()} == pytest.approx(got)
    assert models.drawn_rows(df, ["a", "key"], ["y"], "key", 2, 5) is None
    with pytest.raises(Exception, match="(?i)null"):
        models.forest(df.withColumn("y", F.when(F.col("key") % 7 > 0, F.col("y"))), ["a", "b"], "y", key="key", numTrees=1)


def test_rows_of_a_kind_are_predicted_once(spark):
    df = repeated(spark).withColumn("p", F.lit("old"))
    asked = []
    predict = lambda d: asked.append(d.count()) or d.withColumn("p", F.col("a") * 2 + F.coalesce(F.length("c"), F.lit(7)))
    got = models.by_kind(df, predict, ["a", "c"], ["p"])
    assert asked == [df.select("a", "c").distinct().count()] and got.count() == df.count()
    assert got.filter(F.col("p").isNull() | (F.col("p") != F.col("a") * 2 + F.coalesce(F.length("c"), F.lit(7)))).count() == 0
    assert models.by_kind(df, predict, ["a", "b", "c", "y"], ["p"]).count() == df.count() and asked[-1] == df.count()


def test_values_are_dealt_out_uniformly_within_groups(spark, monkeypatch):
    monkeypatch.setattr(models, "DEAL", 100)  # 16 buckets
    df = spark.range(1200).select(F.col("id").alias("key"), (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 3).alias("o"), F.when(F.col("id") % 9 < 8, 3).alias("g"), (F.col("id") % 10).cast("double").alias("y"), F.when(F.col("id") % 4 > 0, 0.0).alias("z"))
    predict = lambda d: d.withColumns({"p_y": F.col("x"), "p_z": F.col("x") * F.coalesce("g", F.lit(1)) + F.col("o") * 0})
    ask = lambda d, z=("y", "z"): models.dealt_errors(d, predict, list(z), ["x"], ["g"], "key", 20, 5, ["x", "g", "o"], 1200)
    got = {r["d_"]: (r["sse_0"], r["sse_1"]) for r in ask(df)}
    assert {r["d_"]: (r["sse_0"], r["sse_1"]) for r in ask(df.repartition(7))} == got and len(set(got.values())) > 15
    whole = ask(df.withColumn("z", F.lit(0.0)))  # no draw loses a value or moves one to another group
    assert {round(r["sse_1"], 6) for r in whole} == {round(df.agg(F.sum((F.col("x") * F.coalesce("g", F.lit(1))) ** 2)).first()[0], 6)}
    rows = df.select("x", "g", "y").toPandas()
    want = sum(((a.x.to_numpy()[:, None] - a.y.to_numpy()) ** 2).sum() / len(a) for _, a in rows.groupby("g", dropna=False))
    errors = np.array([v for v, _ in got.values()])
    assert abs(errors.mean() - want) < 4 * errors.std() / len(errors) ** 0.5 and 0.01 < errors.std() / want < 0.1
    monkeypatch.setattr(models, "DEALT", 1000)
    monkeypatch.setattr(models, "positions", None)  # rows are not ordered
    one = models.permutation_importance(df, predict, "y", "x", ["g"], "key", 20, 5, reads=["x", "g", "o"]).first()
    assert one.base_r2 == pytest.approx(1.0) and one.importance == pytest.approx(errors.mean() / (1200 * 8.25))
    monkeypatch.setattr(models, "HANDED", 10)
    assert ask(df) is None
