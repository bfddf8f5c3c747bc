"""Boosted trees and staged forests against a sequential brute force, pyspark.ml and their own single fits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import ensembles, models, stats
from causeway.operators.ensembles import Params


def rows_of(spark, n=240, nulls=True):
    rng = random.Random(7)
    out = []
    for i in range(n):
        a, b, c = rng.choice([0.0, 1.5, 2.5, 4.0, 7.0]), rng.randrange(9) / 4, rng.choice("xyz")
        y = (3.0 if a > 2 else -1.0) + b * (2 if c == "y" else -0.5) + rng.random() / 3
        out.append((i, None if nulls and i % 11 == 3 else float("nan") if nulls and i % 11 == 4 else a, b, None if nulls and i % 17 == 1 else c, None if nulls and i % 29 == 5 else y, float(y > 2)))
    return spark.createDataFrame(out, "k long, a double, b double, c string, y double, z double")


def brute(x, y, w, p, objective, base):
    """Trees grown row set by row set, every edge and side tried: (margins)."""
    margin = np.full(len(y), base)
    values = [np.unique(v[~np.isnan(v)]) for v in x]
    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-margin)) if objective == "logistic" else margin
        g, h = (prob - y) * w, (prob * (1 - prob) if objective == "logistic" else np.ones(len(y))) * w
        step, leaves = np.zeros(len(y)), [(np.ones(len(y), bool), 0)]
        share = lambda m: g[m].sum() ** 2 / (h[m].sum() + p.lam)  # noqa: E731,B023
        while leaves:
            at, depth = leaves.pop()
            best = (0.0, None)
            for f, v in enumerate(x):
                for miss in (False, True) if np.isnan(v[at & (w > 0)]).any() else (False,):
                    for e in values[f]:
                        left = at & np.where(np.isnan(v), miss, v <= e)
                        right = at & ~left
                        if depth < p.depth and min(h[left].sum(), h[right].sum()) >= max(p.min_child, 1e-9):
                            gain = (share(left) + share(right) - share(at)) / 2 - p.gamma
                            if gain > best[0] + 1e-7:
                                best = (gain, (left, right))
            if best[1]:
                leaves += [(side, depth + 1) for side in best[1]]
            else:
                step[at] = -g[at].sum() / (h[at].sum() + p.lam)
        margin = margin + p.eta * step
    return margin


@pytest.mark.parametrize(("target", "objective", "params"), [
    ("y", "squared", Params(trees=3, depth=3, eta=0.5, lam=1.0, min_child=5.0)),
    ("y", "squared", Params(trees=2, depth=2, eta=0.3, lam=0.0, gamma=4.0)),
    ("z", "logistic", Params(trees=3, depth=2, eta=0.4, lam=0.5, min_child=2.0)),
])
def test_boosting_equals_brute_force(spark, target, objective, params):
    df = rows_of(spark).repartition(3)
    model = ensembles.fit_boosted(df, ["a", "b", "c"], target, "k", params, objective=objective, every=2)
    got = {r["k"]: r["p"] for r in model.transform(df, "p").collect()}
    known = df.filter(F.col(target).isNotNull()).orderBy("k").toPandas()
    nominal = [np.where(known["c"].isna(), np.nan, (known["c"] == v).astype(float)) for v in "yz"]
    y = known[target].to_numpy(float)
    base = y.mean() if objective == "squared" else np.log(y.mean() / (1 - y.mean()))
    margin = brute([known["a"].to_numpy(float), known["b"].to_numpy(float), *nominal], y, np.ones(len(y)), params, objective, base)
    want = margin if objective == "squared" else 1 / (1 + np.exp(-margin))
    assert np.allclose([got[k] for k in known["k"]], want, atol=2e-4)
    assert len(got) == df.count() and all(v is not None for v in got.values())


def test_held_out_score_is_not_below_the_other_boosting(spark):
    df = rows_of(spark, 800, nulls=False)
    train, test = models.split(df, "k", 1)
    r2 = lambda d, p: d.agg(stats.r2(F.col("y"), F.col(p)).alias("r")).first()["r"]
    own = ensembles.fit_boosted(train, ["a", "b", "c"], "y", "k", Params(trees=12, depth=3, eta=0.3, rows=0.8))
    other = models.boosted(train, ["a", "b", "c"], "y", maxIter=12, maxDepth=3)
    assert r2(own.transform(test, "p"), "p") >= r2(other.transform(test), "p_y") - 0.005


def test_reruns_agree_on_any_partitions(spark):
    df, p = rows_of(spark), Params(trees=4, depth=3, rows=0.7, columns=0.5)
    one = ensembles.fit_boosted(df.coalesce(1), ["a", "b", "c"], "y", "k", p, every=3)
    two = ensembles.fit_boosted(df.repartition(7), ["a", "b", "c"], "y", "k", p)
    for a, b in zip(one.trees, two.trees):
        assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and np.allclose(a.value, b.value, atol=1e-6)


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_a_staged_grid_equals_single_fits(spark, kind):
    df = rows_of(spark).filter("y IS NOT NULL")
    grid = {"trees": [2, 4], "depth": [1, 3]} | ({"min_child": [1.0, 20.0]} if kind == "forest" else {"rows": [0.7]})
    best, scores, fits = ensembles.staged_grid(df, ["a", "b", "c"], "y", "k", grid, kind, folds=2, every=2)
    assert fits == 4 and scores.count() == (4 if kind == "boosted" else 8)  # of 8 and 16
    t = ensembles._binned(df, ["a", "b", "c"], "y", "k", 2, 42, "squared", 256)
    for r in scores.collect():
        p = Params(trees=int(r["trees"]), depth=int(r["depth"]), **({"min_child": r["min_child"]} if kind == "forest" else {"rows": 0.7}))
        mses = []
        for fold in range(2):
            trees = (ensembles._forests(t, [(p, fold)], 42) if kind == "forest" else ensembles._boost(t, [(p, fold)], 42, 10))[0]
            m = ensembles.Ensemble(t.inputs, t.edges, trees, t.base, p.eta, "squared", kind == "forest")
            held = df.filter(F.pmod(F.xxhash64(F.xxhash64("k"), F.lit(42)), F.lit(2)) == fold)
            mses.append(m.transform(held, "p").agg(F.avg((F.col("p") - F.col("y")) ** 2)).first()[0])
        assert r["mse"] == pytest.approx(np.mean(mses), rel=1e-6)
        if r["rank"] == 1:
            assert len(best.trees) == p.trees and best.trees[0].depth == p.depth


def test_the_grid_of_72_takes_a_twelfth_of_the_fits_and_chooses_as_cross_validation_does(spark):
    df = rows_of(spark, 400, nulls=False)
    _, scores, fits = ensembles.staged_grid(df, ["a", "b", "c"], "y", "k", {"trees": [3, 6, 9, 12], "depth": [1, 2, 5], "min_split": [5.0, 10.0, 20.0], "min_child": [1.0, 2.0]}, "forest", folds=3)
    assert scores.count() == 72 and fits == 18  # of 216
    _, small, _ = ensembles.staged_grid(df, ["a", "b", "c"], "y", "k", {"depth": [1, 4], "trees": [10]}, "forest", folds=3)
    fitted, mses = models.grid_search(df, ["a", "b", "c"], "y", {"maxDepth": [1, 4], "numTrees": [10]})
    assert small.filter("rank = 1").first()["depth"] == [1.0, 4.0][int(np.argmin(mses))]


def many(spark):
    """Rows that are equal to the trees, five times over, with keys of their own and some targets moved."""
    copies = rows_of(spark).crossJoin(spark.range(5).withColumnRenamed("id", "i"))
    return copies.withColumns({"k": F.col("k") * 5 + F.col("i"), "y": F.col("y") + F.col("i") / 50, "z": F.when(F.col("i") == 2, 1 - F.col("z")).otherwise(F.col("z"))}).drop("i")


def same_trees(one, two):
    for a, b in zip([t for x in one for t in x], [t for x in two for t in x], strict=True):
        assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and (a.missing_left == b.missing_left).all() and (a.value == b.value).all()


def test_forests_meet_equal_rows_once_and_grow_the_same_trees(spark, monkeypatch):
    df = many(spark).repartition(6)
    t = ensembles._binned(df, ["a", "b", "c"], "y", "k", 2, 42, "squared", 256)
    apart = ensembles.replace(t, merges=False)
    jobs = [(Params(trees=3, depth=4, min_child=c), fold) for c in (1.0, 9.0) for fold in (0, 1)] + [(Params(trees=2, depth=3), -1)]
    assert t.merges
    want = ensembles._forests(apart, jobs, 1)
    same_trees(ensembles._forests(t, jobs, 1), want)
    kinds = t.rows.select("fold", "b").distinct().count()
    assert [r.count() for r, _ in t.made] == [kinds] and 2 * kinds <= t.rows.count()
    assert len(ensembles._forests(t, jobs[:1], 1)[0]) == 3 and len(t.made) == 1  # its draws are known
    monkeypatch.setattr(ensembles, "CELLS", 200)  # a fit a block, and tasks that can't hold their kinds
    same_trees(ensembles._forests(ensembles.replace(t, made=[]), jobs, 1), want)
    assert not ensembles._binned(rows_of(spark).withColumn("b", F.col("k") / 3), ["b"], "y", "k", 2, 42, "squared", 256).merges


def test_forests_dealt_out_by_draw_grow_the_same_trees(spark, monkeypatch):
    jobs = [(Params(trees=n, depth=4, min_child=c, min_split=s, columns=k), fold) for n, c, s, k, fold in ((5, 1.0, 0.0, 1.0, 0), (5, 9.0, 0.0, 1.0, 0), (3, 1.0, 60.0, 1.0, 1), (5, 1.0, 5.0, 0.5, -1))]
    for df, merges in ((many(spark), True), (rows_of(spark).withColumn("b", F.col("b") + F.col("k") / 1e4), False)):
        df = df.filter("y IS NOT NULL").repartition(6)
        t = ensembles._binned(df, ["a", "b", "c"], "y", "k", 2, 42, "squared", 256)
        grid = lambda: ensembles.staged_grid(df, ["a", "b", "c"], "y", "k", {"trees": [2, 5], "depth": [1, 3], "min_child": [1.0, 2.0, 9.0]}, "forest", folds=2)  # noqa: E731,B023
        assert t.merges == merges and not ensembles._dealt(t, jobs)
        want, (best, scores, fits) = ensembles._forests(ensembles.replace(t, merges=False, rows=ensembles.stored(t.rows, "apart")), jobs, 1), grid()
        monkeypatch.setattr(ensembles, "DRAWS", 2)
        assert ensembles._dealt(t, jobs)
        same_trees(ensembles._forests(t, jobs, 1), want)
        got, dealt, again = grid()
        same_trees([got.trees], [best.trees])
        assert fits == again and [tuple(r)[:3] for r in dealt.orderBy("rank").collect()] == [tuple(r)[:3] for r in scores.orderBy("rank").collect()]
        monkeypatch.undo()


def test_poisson_slots_tell_what_the_bounds_tell():
    key = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 300_000)
    assert (ensembles.poisson(key, 5) == np.searchsorted(ensembles.POISSON, ensembles.uniform(key, 5), side="right")).all()


def test_the_registered_grid_of_forests_is_the_references(spark, monkeypatch):
    from causeway.plans import searches

    asked = []
    monkeypatch.setattr(searches.ensembles, "staged_grid", lambda *args, **more: asked.append((args, more)) or (None, None))
    searches.staged_forest_grid(spark, "/root/testdata/sf0.001")
    (args, more), = asked
    assert args[4:] == ({"trees": [100, 200, 300, 500], "depth": [3, 5, 7], "min_split": [5.0, 10.0, 20.0], "min_child": [1.0, 2.0]}, "forest") and more.get("folds", 3) == 3


@pytest.mark.parametrize(("target", "objective"), [("y", "squared"), ("z", "logistic")])
def test_boosting_meets_equal_rows_once_and_grows_the_same_trees(spark, target, objective):
    t = ensembles._binned(many(spark).repartition(6), ["a", "b", "c"], target, "k", 2, 42, objective, 256)
    jobs = [(Params(trees=n, depth=3, rows=r, columns=c), fold) for n, r, c, fold in ((5, 1.0, 1.0, -1), (5, 0.7, 0.5, 0), (3, 0.4, 1.0, 1))]
    want = ensembles._boost(ensembles.replace(t, merges=False), jobs, 3, 10)
    assert t.merges and not t.made
    same_trees(ensembles._boost(t, jobs, 3, 10), want)
    same_trees(ensembles._boost(ensembles.replace(t, made=[]), jobs, 3, 10), want)
    for got in (ensembles._boost(t, jobs, 3, 2), ensembles._boost(ensembles.replace(t, made=[]), jobs, 3, 2)):  # margins stored twice, with the next draws
        for a, b in zip([x for j in got for x in j], [x for j in want for x in j], strict=True):
            assert (a.feature == b.feature).all() and np.allclose(a.value, b.value, atol=1e-6)


def test_rows_of_few_kinds_are_not_stored_and_grow_the_same_trees(spark, monkeypatch):
    zero = F.when(F.col("b") == 0, F.when(F.col("k") % 2 == 0, -0.0).otherwise(0.0)).otherwise(F.col("b"))  # both zeros are one kind
    df = many(spark).withColumn("b", F.when(F.col("k") % 50 < 5, float("inf")).otherwise(zero)).repartition(6)
    kept = []
    monkeypatch.setattr(ensembles, "stored", lambda d, name, real=ensembles.stored: kept.append(real(d, name)) or kept[-1])
    t = ensembles._binned(df, ["a", "b", "c"], "y", "k", 2, 42, "squared", 4)
    ensembles.staged_grid(df, ["a", "b", "c"], "y", "k", {"trees": [1], "depth": [1], "rows": [0.7]}, folds=2, max_bins=4)
    kinds, rows = df.select("a", "b", "c", F.pmod(F.xxhash64(F.xxhash64("k"), F.lit(42)), F.lit(2))).distinct().count(), t.rows.count()
    assert kept and max(d.count() for d in kept) <= kinds <= rows / 2
    own = df.filter("y IS NOT NULL AND abs(b) < double('infinity')").orderBy("b").toPandas()["b"].to_numpy()
    assert t.edges[1].tolist() == sorted({own[-(-len(own) * i // 4) - 1] for i in (1, 2, 3)})
    jobs = [(Params(trees=3, depth=2, rows=0.3), 0)]
    ours = [ensembles._boost(t, jobs, 3, 2), ensembles._forests(t, jobs, 3)]
    monkeypatch.setattr(ensembles, "KINDS", 0)
    other = ensembles._binned(df, ["a", "b", "c"], "y", "k", 2, 42, "squared", 4)
    assert t.kinds is not None and t.stays and other.kinds is None and other.merges
    other.edges, other.rows = t.edges, t.rows  # the sketch's may differ
    for got, want in zip(ours, [ensembles._boost(other, jobs, 3, 2), ensembles._forests(other, jobs, 3)]):
        same_trees(got, want)


def test_kinds_of_many_wide_features():
    rng = np.random.default_rng(3)
    fold, bins, sums = rng.integers(0, 3, 900).astype(np.int32), rng.integers(-1, 2, (900, 9)).astype(np.int32), rng.integers(-9, 9, (900, 4))
    bins[:, 3:] = bins[:, :1] * 30_000  # codes of nine features of 32,768 bins pass 64 bits
    want = {}
    for f, b, s in zip(fold, bins, sums):
        want[f, *b] = want.get((f, *b), 0) + s
    got = ensembles._kinds([(fold[:400], bins[:400], sums[:400]), (fold[400:], bins[400:], sums[400:])], 3, 32_770)
    assert len(got[0]) == len(want) and all((want[f, *b] == s).all() for f, b, s in zip(*got))


def test_equal_settings_rank_in_the_grids_order(spark):
    df = rows_of(spark, 3000, nulls=False).repartition(7)
    _, scores, _ = ensembles.staged_grid(df, ["a", "b", "c"], "y", "k", {"min_split": [9.0, 5.0, 7.0, 3.0, 8.0, 4.0], "depth": [1]}, "forest", folds=3, trees=7)
    assert [r["min_split"] for r in scores.orderBy("rank").collect()] == [9.0, 5.0, 7.0, 3.0, 8.0, 4.0] and scores.select("mse").distinct().count() == 1


def test_edge_cases(spark):
    df = rows_of(spark)
    for bad in (df.limit(0), df.withColumn("y", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            ensembles.fit_boosted(bad, ["a", "b"], "y", "k")
    with pytest.raises(ValueError):
        ensembles.fit_boosted(df, ["a"], "y", "k", objective="logistic")
    flat = df.withColumns({"one": F.lit(4.0), "y": F.lit(2.0), "g": F.col("b"), "fit": F.col("b"), "bin": F.lit(1)})
    model = ensembles.fit_boosted(flat, ["one", "g", "fit"], "y", "k", Params(trees=2, depth=2))
    assert {r["p"] for r in model.transform(flat, "p").collect()} == {2.0}
    far = df.withColumn("a", F.when(F.col("k") < 9, float("inf")).otherwise(F.col("a")))
    assert ensembles.fit_boosted(far, ["a"], "y", "k", Params(trees=1)).transform(far, "p").filter("p IS NULL OR isnan(p)").count() == 0
