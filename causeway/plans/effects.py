"""Queries on causal effects, importance, rescaling, augmentation and learnt models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import columns
from causeway.functions.columns import hash_uniform_sql
from causeway.operators import bayes, causal, models, rescale, stats
from causeway.sources.tables import read_table


def _items(spark, d, *cols) -> DataFrame:
    rows = read_table(spark, f"{d}/lineitem.parquet")
    return rows.select(*cols) if cols else rows


def _codes(spark, d) -> DataFrame:
    """x, z, y as small integer codes."""
    rows = _items(spark, d)
    x = columns.recode(F.col("l_returnflag"), {"A": 0, "N": 1, "R": 2}, F.lit(3))
    return rows.select(x.alias("x"), F.col("l_linenumber").alias("z"), (F.col("l_linestatus") == "O").cast("int").alias("y"), F.ceil(F.col("l_quantity") / 10).cast("int").alias("w"))


def do_probability(spark, d):
    c = stats.contingency(_codes(spark, d), ["x", "z", "y"])
    return causal.do_probability(c, "x", "y", ["z"]).select("x", "y", F.round("p", 9).alias("p"), F.round("coverage", 9).alias("coverage"))


def do_probability_root(spark, d):
    c = stats.contingency(_codes(spark, d), ["x", "y"])
    return causal.do_probability(c, "x", "y", []).select("x", "y", F.round("p", 9).alias("p"))


def ace(spark, d):
    c = stats.contingency(_codes(spark, d), ["x", "z", "y"])
    return causal.average_causal_effect(causal.do_probability(c, "x", "y", ["z"]), "x", "y").select(F.round("ace", 9).alias("ace"))


def ace_edges(spark, d):
    c = stats.contingency(_codes(spark, d), ["x", "z", "y", "w"])
    out = causal.edge_effects(c, {("z", "x"), ("x", "y"), ("w", "y")}, ["x", "z", "y", "w"])
    return out.select("cause", "effect", F.round("ace", 9).alias("ace"))


def _effect(spark, d, x, y, adjust):
    out = causal.adjusted_effect(_items(spark, d), x, y, adjust)
    return out.select("feature", "target", F.round("effect", 4).alias("effect"), "method", "n")


def ols_adjusted_1(spark, d):
    return _effect(spark, d, "l_quantity", "l_extendedprice", [])


def ols_adjusted_2(spark, d):
    return _effect(spark, d, "l_quantity", "l_extendedprice", ["l_discount"])


def ols_dummy(spark, d):
    return _effect(spark, d, "l_quantity", "l_extendedprice", ["l_linestatus"])


def logit_effect(spark, d):
    out = causal.adjusted_effect(_items(spark, d), "l_quantity", "l_linestatus", ["l_discount"])
    return out.select("feature", "target", F.round("effect", 6).alias("effect"), "method", "n")


def generator_rankings(spark, d):
    m = _items(spark, d).groupBy("l_linenumber", "l_returnflag").agg(F.round(F.avg("l_extendedprice"), 4).alias("mae"), F.round(F.avg("l_discount"), 9).alias("ks"))
    out = bayes.generator_rankings(m.withColumnRenamed("l_returnflag", "outcome"), "l_linenumber")
    return out.select("ranking", "rank", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("mean_mae", "mean_ks", "tradeoff")])


def _slopes(spark, d):
    """Effects, sensitivities and importances of two features on two targets in each line number, as regressions give them."""
    rows = _items(spark, d)
    pairs = [(t, f) for t in ("l_extendedprice", "l_discount") for f in ("l_quantity", "l_tax")]
    agg = rows.groupBy("l_linenumber").agg(*[x for i, (t, f) in enumerate(pairs) for x in (F.round(F.regr_slope(t, f), 6).alias(f"s{i}"), F.round(F.abs(F.corr(t, f)), 6).alias(f"c{i}"))])
    cells = F.array(*[F.struct(F.lit(t).alias("target"), F.concat(F.lit(f"{f}_"), F.col("l_linenumber").cast("string")).alias("feature"), F.col(f"s{i}").alias("effect"), F.col(f"c{i}").alias("permutation")) for i, (t, f) in enumerate(pairs)])
    return agg.select("l_linenumber", F.inline(cells))


def spurious_flags(spark, d):
    s = _slopes(spark, d)
    effects = s.filter("l_linenumber <> 2").select("target", "feature", "effect")
    importance = s.filter("l_linenumber <> 5").select("target", "feature", (F.col("l_linenumber") - 3.0).alias("sensitivity"), "permutation")
    out = causal.spurious_flags(effects, importance)
    return out.select("target", "feature", *[F.round(c, 9).alias(c) for c in ("effect_pct", "sens_pct", "perm_pct")], "spurious", "coherent")


BOUNDS = [0.0, 10.0, 25.0, 51.0]


def scale_ranges(spark, d):
    rows = _items(spark, d, "l_linestatus", "l_quantity")
    a, b = rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus = 'O'")
    parts = [rescale.scale_ranges(a, b, "l_quantity", BOUNDS, v, cap).withColumn("variant", F.lit(v)) for v, cap in (("percentile", 20.0), ("minmax", None), ("median", None), ("whole", None))]
    return reduce(DataFrame.unionByName, parts).select("variant", "cluster", F.round("s_min", 6).alias("s_min"), F.round("s_max", 6).alias("s_max"))


def mid_range_scaling(spark, d):
    rows = _items(spark, d, "l_linestatus", "l_quantity")
    a, b = rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus = 'O'")
    ranges = rescale.scale_ranges(a, b, "l_quantity", BOUNDS, "percentile", 20.0)
    return rescale.apply_mid_factors(b, ranges, "l_quantity", BOUNDS).agg(F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.count("*").alias("n"))


def _small(spark, d):
    """A validation table of the size such searches run on, with two targets."""
    rows = _items(spark, d, "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice").withColumn("t", F.col("l_tax") * 10)
    return rows.withColumnsRenamed({"l_quantity": "q", "l_discount": "u"}).withColumn("y", F.col("l_extendedprice") / 1000)


def _model(df):
    return df.withColumns({"p_y": F.col("q") * 1.2 + F.col("u") * 20, "p_t": F.col("u") * 4 + 0.2})


READS = ["q", "u"]  # all that _model reads
OBJECTIVE = rescale.Objective((("y", "p_y"), ("t", "p_t")), "r2")
FACTORS = rescale.frange(0.2, 2.0, 0.2)
#: Most MSE of both targets: the factor of u with the best R2 breaks the first, so the limit decides.
LIMITS = (1660.0, 0.11)


def _found(spark, factors: dict[str, float], kind: str):
    return spark.createDataFrame([(kind, c, f) for c, f in factors.items()], "kind string, col string, factor double")


def greedy_scale_search(spark, d):
    return _found(spark, rescale.greedy_scale_search(_small(spark, d), ["q", "u"], _model, OBJECTIVE, FACTORS, READS)[0], "r2")


def objective_variants(spark, d):
    rows, out = _small(spark, d), []
    for kind in ("mse", "tolerance", "constrained"):
        o = rescale.Objective(OBJECTIVE.pairs, kind, (100.0, 0.25), LIMITS)
        out.append(rescale.best_of(rescale.search(rows, "u" if kind == "constrained" else "q", FACTORS, _model, o, reads=READS)).select(F.lit(kind).alias("kind"), "factor", F.round("value", 4).alias("value")))
    return reduce(DataFrame.unionByName, out)


def cluster_scale_search(spark, d):
    specs = [rescale.ClusterSpec(0, 20, tuple(FACTORS)), rescale.ClusterSpec(20, 50, tuple(FACTORS))]
    found, scaled = rescale.cluster_scale_search(_small(spark, d), "q", specs, _model, OBJECTIVE, READS)
    return scaled.agg(F.round(F.avg("q"), 6).alias("mean_q")).withColumns({"f_low": F.lit(found[0]), "f_high": F.lit(found[1])})


def weight_search(spark, d):
    rows = _small(spark, d).withColumn("q", F.col("q") * 0.5)
    return _found(spark, rescale.weight_search(rows, ["q", "u"], _model, OBJECTIVE, 0.5, 3.0, 0.01, READS)[0], "weight")


def grid_scale_search(spark, d):
    grid = rescale.grid_candidates(spark, {"q": [0.5, 1.0, 1.5], "u": [0.5, 1.0, 2.0]})
    out = rescale.joint_search(_small(spark, d), grid, ["q", "u"], _model, OBJECTIVE, READS)
    return out.select("i", "f_q", "f_u", F.round("value", 6).alias("value"))


def random_scale_search(spark, d):
    out = rescale.joint_search(_small(spark, d), rescale.random_candidates(spark, ["q", "u"], 500), ["q", "u"], _model, OBJECTIVE, READS)
    return out.select("i", F.round("f_q", 9).alias("f_q"), F.round("f_u", 9).alias("f_u"), F.round("value", 4).alias("value"))


def refine_expression(spark, d):
    one = lambda df: df.withColumns({"a": F.col("q") * 1.5, "b": F.col("u") * 2})
    two = lambda df: df.withColumn("a", F.col("q") * 1.4 + F.col("b") * 0.5)
    three = lambda df: df.withColumn("b", F.col("u") * 3 + F.col("a") * 0.01)
    out = rescale.refine(_small(spark, d), one, two, three, 5)
    return out.groupBy("l_linenumber").agg(F.round(F.avg("a"), 6).alias("a"), F.round(F.avg("b"), 6).alias("b"))


def _orders(spark, d):
    return read_table(spark, f"{d}/orders.parquet").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus")


def augment_interpolate(spark, d):
    rows = _orders(spark, d).select("o_orderkey", "o_totalprice", "o_orderstatus")
    out = rescale.augment_interpolate(rows, "o_orderkey", ["o_totalprice"])
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 3).alias("mean_price"))


def augment_random_pairs(spark, d):
    rows = _orders(spark, d).select("o_orderkey", "o_totalprice", "o_orderstatus")
    out = rescale.augment_interpolate(rows, "o_orderkey", ["o_totalprice"], shift=None)
    return out.groupBy(F.col("o_orderstatus").isNull().alias("drawn")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 3).alias("mean_price"), F.round(F.max("o_totalprice"), 3).alias("most"))


def augment_exclusive(spark, d):
    """Two columns of which a row has one: combinations of random pairs keep that, and stay above 0."""
    rows = _items(spark, d).groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key")).agg(F.min("l_quantity").alias("q"), F.min("l_tax").alias("l_tax"))  # a key may occur twice
    rows = rows.withColumns({"a": F.col("q") - 30, "b": F.greatest(20 - F.col("q"), F.lit(0.0))})
    out = rescale.augment_interpolate(rows, "key", ["a", "b", "l_tax"], shift=None, exclusive=("a", "b"))
    return out.filter("q is null").groupBy((F.col("a") > 0).alias("has_a"), (F.col("b") > 0).alias("has_b")).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("a", "b", "l_tax")])


def augment_noise(spark, d):
    out = rescale.augment_noise(_orders(spark, d), "o_orderkey", ["o_totalprice"])
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"))


def _labelled(spark, d):
    rows = _items(spark, d, "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_linestatus", "l_extendedprice", "l_tax")
    rows = rows.withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rows.select("key", "l_quantity", "l_discount", "l_linestatus", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_tax") * 10).alias("t"))


FEATURES = ["l_quantity", "l_discount", "l_linestatus"]


def _refined(spark, d, rounds: int = 5):
    rows = _labelled(spark, d)
    train, test = models.split(rows, "key", 42)
    return models.fit_refined(train, FEATURES, ("y", "t"), rounds, boosting={"maxIter": 10}, key="key", maxDepth=4, numTrees=8), test


def rf_refined(spark, d):
    model, test = _refined(spark, d)
    return stats.regression_metrics(models.by_kind(test, model.transform, FEATURES, ["p_y", "p_t"]), [("y", "p_y"), ("t", "p_t")])


def seed_sweep(spark, d):
    """The seed whose forest did best on its own training rows and on fixed validation rows, and both R2."""
    rows = _labelled(spark, d)
    known, validation = models.split(rows, "key", 7)
    fit = lambda train, seed: models.forest(train, FEATURES, "y", seed, maxDepth=4, numTrees=5)
    _, best = models.seed_sweep(known, "key", "y", fit, validation, [1, 2, 3])
    return spark.createDataFrame([(best["seed"], float(best["train"]), float(best["validation"]))], "seed int, train double, validation double")


def separate_scales(spark, d):
    model, test = _refined(spark, d, rounds=2)
    out = models.by_kind(test, lambda df: models.separate_scales(df, model, {"y": ("l_quantity", 1.1)}), FEATURES, ["p_y", "p_t"])
    return stats.regression_metrics(out, [("y", "p_y"), ("t", "p_t")])


def permutation_importance(spark, d):
    rows = _labelled(spark, d)
    model = models.forest(rows, FEATURES, "y", key="key", maxDepth=4, numTrees=8)
    predict = lambda df: model.transform(df.drop("p_y", "x_y"))
    parts = [models.permutation_importance(rows, predict, "y", f, z, "key", 10, reads=FEATURES).select(F.lit(f).alias("feature"), "importance", "base_r2") for f, z in (("l_quantity", ["l_linestatus"]), ("l_discount", []))]
    return reduce(DataFrame.unionByName, parts)


def sensitivity(spark, d):
    rows = _labelled(spark, d)
    model = models.forest(rows, FEATURES, "y", maxDepth=4, numTrees=8)
    predict = lambda df: model.transform(df)
    a = models.sensitivity(rows, predict, "y", "l_quantity", "key").withColumn("feature", F.lit("l_quantity"))
    return a.unionByName(models.sensitivity(rows, predict, "y", "l_linestatus", "key", swap=("F", "O")).withColumn("feature", F.lit("l_linestatus")))


def grid_search_cv(spark, d):
    _, mse = models.grid_search(_labelled(spark, d), FEATURES, "y", {"maxDepth": [2, 4], "numTrees": [5]}, folds=2)
    return spark.createDataFrame([(i, float(m)) for i, m in enumerate(mse)], "i int, mse double")


def poly_calibration(spark, d):
    rows = _labelled(spark, d).withColumn("p", F.col("l_quantity") * 1.2)
    fitted = rescale.calibrate_polynomial(rows, "p", "y", 3)
    return fitted.apply(rows, "p", "c").agg(F.round(stats.r2(F.col("y"), F.col("p")), 6).alias("before"), F.round(stats.r2(F.col("y"), F.col("c")), 6).alias("after"))


def isotonic_calibration(spark, d):
    rows = _labelled(spark, d).withColumn("p", F.col("l_quantity") * 1.2)
    fitted = rescale.calibrate_isotonic(rows, "p", "y")
    return fitted.apply(rows, "p", "c").agg(F.round(stats.r2(F.col("y"), F.col("p")), 6).alias("before"), F.round(stats.r2(F.col("y"), F.col("c")), 6).alias("after"))


QUERIES = {f.__name__: f for f in (logit_effect, generator_rankings, augment_random_pairs, seed_sweep, separate_scales, do_probability, do_probability_root, ace, ace_edges, ols_adjusted_1, ols_adjusted_2, ols_dummy, spurious_flags, scale_ranges, mid_range_scaling, greedy_scale_search, objective_variants, cluster_scale_search, weight_search, grid_scale_search, random_scale_search, refine_expression, augment_interpolate, augment_exclusive, augment_noise, rf_refined, permutation_importance, sensitivity, grid_search_cv, poly_calibration, isotonic_calibration)}

_X = "b AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS x, l_linenumber AS z, CAST(l_linestatus = 'O' AS INTEGER) AS y, CAST(ceil(l_quantity / 10) AS INTEGER) AS w FROM lineitem)"
_DO = """z AS (SELECT z, count(*)::DOUBLE / (SELECT count(*) FROM b) AS pz FROM b GROUP BY z),
g AS (SELECT x, z, y, count(*)::DOUBLE / (sum(count(*)) OVER (PARTITION BY x, z))::DOUBLE AS py FROM b GROUP BY x, z, y),
v AS (SELECT x, sum(pz) AS coverage FROM (SELECT DISTINCT x, z FROM b) JOIN z USING (z) GROUP BY x),
p AS (SELECT x, y, sum(py * pz) AS p FROM g JOIN z USING (z) GROUP BY x, y)"""
_ACE = "CASE WHEN count(*) > 1 THEN (sum(m) - min_by(m, c)) / (count(*) - 1) - min_by(m, c) ELSE 0 END"


def _root_ace(cause: str, effect: str) -> str:
    return f"SELECT '{cause}' AS cause, '{effect}' AS effect, round({_ACE}, 9) AS ace FROM (SELECT {cause} AS c, avg({effect}) AS m FROM b GROUP BY 1)"


_SMALL = "b AS (SELECT l_linenumber, l_quantity AS q, l_discount AS u, l_tax * 10 AS t, l_extendedprice / 1000 AS y FROM lineitem)"


def _value(q: str = "q", u: str = "u", kind: str = "r2") -> str:
    py, pt = f"({q} * 1.2::DOUBLE + {u} * 20)", f"({u} * 4 + 0.2::DOUBLE)"
    part = lambda y, p, tol: {"r2": f"1 - sum(({y} - {p}) ** 2) / (var_pop({y}) * count(*))", "mse": f"-avg(({y} - {p}) ** 2)", "tolerance": f"1 - avg(({y} - {p}) ** 2) / {tol}"}[kind]
    return f"(({part('y', py, '100')}) + ({part('t', pt, '0.25::DOUBLE')})) / 2"


def _list(xs) -> str:
    return "[" + ", ".join(f"{x}::DOUBLE" for x in xs) + "]"


def _cand(xs) -> str:
    return f"(SELECT unnest(range({len(xs)})) AS i, unnest({_list(xs)}) AS f)"


def _best(name: str, q: str, u: str, xs, where: str = "b", kind: str = "r2") -> str:
    return f"{name} AS (SELECT f, v FROM (SELECT i, f, {_value(q, u, kind)} AS v FROM {where}, {_cand(xs)} GROUP BY i, f) ORDER BY v DESC, i LIMIT 1)"


_W = rescale.frange(0.5, 3.0, 0.01)
_GRID = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in (0.5, 1.0, 1.5) for b in (0.5, 1.0, 2.0))]


def _range_sql(variant: str, a: str, b: str, cap: float | None, whole: bool = False) -> str:
    hi = f"least(hi_a / greatest(lo_b, 1e-6::DOUBLE), {cap}::DOUBLE)" if cap else "hi_a / greatest(lo_b, 1e-6::DOUBLE)"
    left = f"(SELECT {a} FROM lineitem, (SELECT 1) WHERE l_linestatus = 'F') l" if whole else f"(SELECT {{c}} AS cluster, {a} FROM lineitem WHERE l_linestatus = 'F' AND {{c}} IS NOT NULL GROUP BY 1) l"
    right = f"(SELECT {{c}} AS cluster, {b} FROM lineitem WHERE l_linestatus = 'O' AND {{c}} IS NOT NULL GROUP BY 1) r"
    case = "CASE WHEN l_quantity >= 0 AND l_quantity < 10 THEN 0 WHEN l_quantity >= 10 AND l_quantity < 25 THEN 1 WHEN l_quantity >= 25 AND l_quantity < 51 THEN 2 END"
    joined = f"{right}, {left}" if whole else f"{right} JOIN {left} USING (cluster)"
    return f"SELECT '{variant}' AS variant, cluster, round(greatest(lo_a / greatest(hi_b, 1e-6::DOUBLE), 0.01::DOUBLE), 6) AS s_min, round({hi}, 6) AS s_max FROM {joined}".replace("{c}", case)


_Q = lambda p: f"quantile_cont(l_quantity, {p})"
_MED = "median(CASE WHEN l_quantity <> 0 THEN l_quantity END)"
_RANGES = {
    "percentile": _range_sql("percentile", f"{_Q(0.05)} AS lo_a, {_Q(0.95)} AS hi_a", f"{_Q(0.01)} AS lo_b, {_Q(0.99)} AS hi_b", 20.0),
    "minmax": _range_sql("minmax", "min(l_quantity) AS lo_a, max(l_quantity) AS hi_a", "min(l_quantity) AS lo_b, max(l_quantity) AS hi_b", 25.0),
    "median": _range_sql("median", f"{_Q(0.05)} AS lo_a, {_Q(0.95)} AS hi_a", f"{_MED} AS lo_b, {_MED} AS hi_b", 25.0),
    "whole": _range_sql("whole", f"{_Q(0.05)} AS lo_a, {_Q(0.95)} AS hi_a", f"{_Q(0.05)} AS lo_b, {_Q(0.95)} AS hi_b", None, True),
}
_REFINED = "1.4::DOUBLE * q + 0.5::DOUBLE * {b}", "3 * u + 0.01::DOUBLE * ({a})"
_b = "2 * u"
for _ in range(5):
    _a = _REFINED[0].format(b=f"({_b})")
    _b = _REFINED[1].format(a=_a)
_SLOPE = " UNION ALL ".join(f"SELECT l_linenumber, '{t}' AS target, '{f}_' || l_linenumber AS feature, round(regr_slope({t}, {f}), 6) AS effect, round(abs(corr({t}, {f})), 6) AS permutation FROM lineitem GROUP BY l_linenumber" for t in ("l_extendedprice", "l_discount") for f in ("l_quantity", "l_tax"))
_PCT = lambda v: f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (PARTITION BY target ORDER BY {v} NULLS LAST) + (count(*) OVER (PARTITION BY target, {v}) - 1)::DOUBLE / 2) / count({v}) OVER (PARTITION BY target) END"

SQL = {
    "do_probability": f"WITH {_X}, {_DO} SELECT x, y, round(p, 9) AS p, round(coverage, 9) AS coverage FROM p JOIN v USING (x)",
    "do_probability_root": f"WITH {_X} SELECT x, y, round(count(*)::DOUBLE / (sum(count(*)) OVER (PARTITION BY x))::DOUBLE, 9) AS p FROM b GROUP BY x, y",
    "ace": f"WITH {_X}, {_DO} SELECT round({_ACE}, 9) AS ace FROM (SELECT x AS c, sum(p * y) AS m FROM p GROUP BY x)",
    "ace_edges": f"WITH {_X}, {_DO} {_root_ace('z', 'x')} UNION ALL {_root_ace('w', 'y')} UNION ALL SELECT 'x', 'y', round({_ACE}, 9) FROM (SELECT x AS c, sum(p * y) AS m FROM p GROUP BY x)",
    "ols_adjusted_1": "SELECT 'l_quantity' AS feature, 'l_extendedprice' AS target, round(regr_slope(l_extendedprice, l_quantity), 4) AS effect, 'ols' AS method, count(*) AS n FROM lineitem",
    "ols_adjusted_2": """
SELECT 'l_quantity' AS feature, 'l_extendedprice' AS target, round((covar_pop(l_extendedprice, l_quantity) * var_pop(l_discount) - covar_pop(l_extendedprice, l_discount) * covar_pop(l_quantity, l_discount)) / (var_pop(l_quantity) * var_pop(l_discount) - covar_pop(l_quantity, l_discount) ** 2), 4) AS effect, 'ols' AS method, count(*) AS n FROM lineitem""",
    "ols_dummy": """
WITH m AS (SELECT l_quantity AS x, l_extendedprice AS y, avg(l_quantity) OVER (PARTITION BY l_linestatus) AS mx, avg(l_extendedprice) OVER (PARTITION BY l_linestatus) AS my FROM lineitem)
SELECT 'l_quantity' AS feature, 'l_extendedprice' AS target, round(sum((x - mx) * (y - my)) / sum((x - mx) ** 2), 4) AS effect, 'ols' AS method, count(*) AS n FROM m""",
    "spurious_flags": f"""
WITH s AS ({_SLOPE}), e AS (SELECT target, feature, effect FROM s WHERE l_linenumber <> 2), i AS (SELECT target, feature, l_linenumber - 3 AS sensitivity, permutation FROM s WHERE l_linenumber <> 5),
j AS (SELECT coalesce(e.target, i.target) AS target, coalesce(e.feature, i.feature) AS feature, effect, sensitivity, permutation, abs(effect) AS ea, abs(sensitivity) AS sa, abs(permutation) AS pa FROM e FULL JOIN i ON e.target = i.target AND e.feature = i.feature),
r AS (SELECT *, {_PCT('ea')} AS ep, {_PCT('sa')} AS sp, {_PCT('pa')} AS pp FROM j)
SELECT target, feature, round(ep, 9) AS effect_pct, round(sp, 9) AS sens_pct, round(pp, 9) AS perm_pct, coalesce(ep <= 0.40::DOUBLE AND (sp >= 0.60::DOUBLE OR pp >= 0.60::DOUBLE), FALSE) AS spurious, coalesce(effect * sensitivity > 0, FALSE) AS coherent FROM r""",
    "scale_ranges": " UNION ALL ".join(_RANGES.values()),
    "mid_range_scaling": f"WITH r AS ({_RANGES['percentile'].replace('round(greatest(lo_a', '(greatest(lo_a').replace('0.01::DOUBLE), 6)', '0.01::DOUBLE))').replace('round(least(', '(least(').replace('20.0::DOUBLE), 6)', '20.0::DOUBLE))')}) SELECT round(avg(l_quantity * coalesce((s_min + s_max) / 2, 1)), 6) AS mean_quantity, count(*) AS n FROM lineitem LEFT JOIN r ON r.cluster = CASE WHEN l_quantity >= 0 AND l_quantity < 10 THEN 0 WHEN l_quantity >= 10 AND l_quantity < 25 THEN 1 WHEN l_quantity >= 25 AND l_quantity < 51 THEN 2 END WHERE l_linestatus = 'O'",
    "greedy_scale_search": f"WITH {_SMALL}, {_best('r1', 'q * f', 'u', FACTORS)}, {_best('r2', 'q * (SELECT f FROM r1)', 'u * f', FACTORS)} SELECT 'r2' AS kind, 'q' AS col, f AS factor FROM r1 UNION ALL SELECT 'r2', 'u', f FROM r2",
    "objective_variants": f"WITH {_SMALL}, {_best('r1', 'q * f', 'u', FACTORS, kind='mse')}, {_best('r2', 'q * f', 'u', FACTORS, kind='tolerance')}, r3 AS (SELECT f, v FROM (SELECT i, f, {_value('q', '(u * f)')} AS v, avg((y - (q * 1.2::DOUBLE + u * f * 20)) ** 2) AS my, avg((t - (u * f * 4 + 0.2::DOUBLE)) ** 2) AS mt FROM b, {_cand(FACTORS)} GROUP BY i, f) WHERE my <= {LIMITS[0]} AND mt <= {LIMITS[1]} ORDER BY v DESC, i LIMIT 1) SELECT 'mse' AS kind, f AS factor, round(v, 4) AS value FROM r1 UNION ALL SELECT 'tolerance', f, round(v, 4) FROM r2 UNION ALL SELECT 'constrained', f, round(v, 4) FROM r3",
    "cluster_scale_search": f"WITH {_SMALL}, {_best('r1', '(CASE WHEN q BETWEEN 0 AND 20 THEN q * f ELSE q END)', 'u', FACTORS)}, {_best('r2', '(CASE WHEN q BETWEEN 20 AND 50 THEN q * f ELSE q END)', 'u', FACTORS)} SELECT round(avg(CASE WHEN q BETWEEN 20 AND 50 THEN q * (SELECT f FROM r2) WHEN q BETWEEN 0 AND 20 THEN q * (SELECT f FROM r1) ELSE q END), 6) AS mean_q, (SELECT f FROM r1) AS f_low, (SELECT f FROM r2) AS f_high FROM b",
    "weight_search": f"WITH {_SMALL}, {_best('r1', '(q * 0.5::DOUBLE) * f', 'u', _W)}, {_best('r2', '(q * 0.5::DOUBLE) * (SELECT f FROM r1)', 'u * f', _W)} SELECT 'weight' AS kind, 'q' AS col, f AS factor FROM r1 UNION ALL SELECT 'weight', 'u', f FROM r2",
    "grid_scale_search": f"WITH {_SMALL}, g AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, a, b in _GRID) + f") v(i, f_q, f_u)) SELECT i, f_q, f_u, round({_value('(q * f_q)', '(u * f_u)')}, 6) AS value FROM b, g GROUP BY 1, 2, 3",
    "augment_random_pairs": f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY {hash_uniform_sql('o_orderkey', 42)}, o_orderkey) AS at, count(*) OVER () AS n FROM orders),
m AS (SELECT a.o_totalprice * {hash_uniform_sql('a.o_orderkey', 1)} + b.o_totalprice * (1 - {hash_uniform_sql('a.o_orderkey', 1)}) AS v FROM r a JOIN r b ON b.at = a.at % a.n + 1)
SELECT drawn, count(*) AS n, round(avg(v), 3) AS mean_price, round(max(v), 3) AS most FROM (SELECT false AS drawn, o_totalprice AS v FROM orders UNION ALL SELECT true, v FROM m) GROUP BY drawn""",
    "augment_exclusive": f"""
WITH k AS (SELECT key, q - 30 AS a, greatest(20 - q, 0) AS b, l_tax FROM (SELECT l_orderkey * 10 + l_linenumber AS key, min(l_quantity) AS q, min(l_tax) AS l_tax FROM lineitem GROUP BY 1)),
r AS (SELECT *, row_number() OVER (ORDER BY {hash_uniform_sql('key', 42)}, key) AS at, count(*) OVER () AS n, {hash_uniform_sql('key', 1)} AS w FROM k),
m AS (SELECT x.a * x.w + y.a * (1 - x.w) AS a, x.b * x.w + y.b * (1 - x.w) AS b, x.l_tax * x.w + y.l_tax * (1 - x.w) AS l_tax FROM r x JOIN r y ON y.at = x.at % x.n + 1),
o AS (SELECT a, CASE WHEN a > 0 THEN 0 ELSE b END AS b, l_tax FROM m), p AS (SELECT greatest(CASE WHEN b > 0 THEN 0 ELSE a END, 0) AS a, greatest(b, 0) AS b, l_tax FROM o)
SELECT a > 0 AS has_a, b > 0 AS has_b, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(l_tax), 6) AS mean_l_tax FROM p GROUP BY 1, 2""",
    "generator_rankings": """
WITH m AS (SELECT l_linenumber, l_returnflag, round(avg(l_extendedprice), 4) AS mae, round(avg(l_discount), 9) AS ks FROM lineitem GROUP BY 1, 2),
g AS (SELECT l_linenumber, avg(mae) AS mean_mae, avg(ks) AS mean_ks FROM m GROUP BY 1),
t AS (SELECT *, (mean_mae - min(mean_mae) OVER ()) / (max(mean_mae) OVER () - min(mean_mae) OVER ()) + (mean_ks - min(mean_ks) OVER ()) / (max(mean_ks) OVER () - min(mean_ks) OVER ()) AS tradeoff FROM g),
r AS (SELECT 'mean_mae' AS ranking, CAST(row_number() OVER (ORDER BY mean_mae, l_linenumber) AS INTEGER) AS rank, * FROM t UNION ALL
  SELECT 'mean_ks', CAST(row_number() OVER (ORDER BY mean_ks, l_linenumber) AS INTEGER), * FROM t UNION ALL SELECT 'tradeoff', CAST(row_number() OVER (ORDER BY tradeoff, l_linenumber) AS INTEGER), * FROM t)
SELECT ranking, rank, l_linenumber, round(mean_mae, 6) AS mean_mae, round(mean_ks, 6) AS mean_ks, round(tradeoff, 6) AS tradeoff FROM r WHERE rank <= 3""",
    "random_scale_search": f"WITH {_SMALL}, g AS (SELECT CAST(i AS INTEGER) AS i, {hash_uniform_sql('i', 0)} * (5 - 0.05::DOUBLE) + 0.05::DOUBLE AS f_q, {hash_uniform_sql('i', 1)} * (5 - 0.05::DOUBLE) + 0.05::DOUBLE AS f_u FROM (SELECT unnest(range(500)) AS i)) SELECT i, round(f_q, 9) AS f_q, round(f_u, 9) AS f_u, round({_value('(q * f_q)', '(u * f_u)')}, 4) AS value FROM b, g GROUP BY i, g.f_q, g.f_u",
    "refine_expression": f"WITH {_SMALL} SELECT l_linenumber, round(avg({_a}), 6) AS a, round(avg({_b}), 6) AS b FROM b GROUP BY 1",
    "augment_interpolate": f"""
WITH n AS (SELECT o.o_totalprice * {hash_uniform_sql('o.o_orderkey', 1)} + p.o_totalprice * (1 - {hash_uniform_sql('o.o_orderkey', 1)}) AS o_totalprice FROM orders o JOIN orders p ON p.o_orderkey = o.o_orderkey + 7),
a AS (SELECT o_totalprice, o_orderstatus FROM orders UNION ALL SELECT o_totalprice, NULL FROM n)
SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 3) AS mean_price FROM a GROUP BY 1""",
    "augment_noise": f"""
WITH s AS (SELECT stddev_samp(o_totalprice) AS sd FROM orders),
n AS (SELECT o_orderstatus, greatest(0, o_totalprice + sqrt(-2 * ln(greatest({hash_uniform_sql('o_orderkey', 1)}, 1e-12::DOUBLE))) * cos(2 * pi() * {hash_uniform_sql('o_orderkey', 2)}) * sd * 0.05::DOUBLE) AS o_totalprice FROM orders, s),
a AS (SELECT o_orderstatus, o_totalprice FROM orders UNION ALL SELECT * FROM n)
SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 2) AS mean_price FROM a GROUP BY 1""",
}
