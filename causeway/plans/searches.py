"""Queries over many graphs, groups or features at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions.columns import hash_uniform_sql
from causeway.operators import bayes, causal, cube, ensembles, generators, graph, isotonic, models, stats, sweeps, validation
from causeway.sources.tables import read_table

#: Seven inputs and two outcomes of line items, binned, as SQL that both engines read.
NINE = {
    "f": "l_returnflag", "s": "l_linestatus", "t": "l_linenumber", "d": "CAST(round(l_discount * 100) AS INTEGER)", "x": "CAST(round(l_tax * 100) AS INTEGER)", "y": "year(l_shipdate)", "m": "quarter(l_shipdate)",
    "q": "CAST(ceil(l_quantity / 10) AS INTEGER)", "e": "CAST(floor(l_extendedprice / 20000) AS INTEGER)",
}
TRIO_DAGS = dict(enumerate(bayes.without_direct_edges([d for t in bayes.node_combinations(list(NINE)).values() for d in bayes.enumerate_dags(t, bayes.outcome_constraints(["q", "e"], list(NINE)[:7]))], [("t", "s"), ("t", "f")]), 1))


def trio_scores(spark, d):
    """All admissible graphs over all triples of nine columns (819), scored."""
    rows = read_table(spark, f"{d}/lineitem.parquet").selectExpr(*[f"{v} AS {c}" for c, v in NINE.items()])
    out = cube.score_trios(rows, TRIO_DAGS, list(NINE))
    return out.select("dag_id", "edges", "k", *[F.round(c, 3).alias(c) for c in ("ll", "aic", "bic")], F.round("similarity", 6).alias("similarity"))


EXACT = 500


def ks_p_values(spark, d):
    """Prices of two return flags compared in every supplier (small samples) and in every line number (large ones)."""
    rows = read_table(spark, f"{d}/lineitem.parquet").select("l_returnflag", "l_extendedprice", F.explode(F.array(F.concat(F.lit("supplier "), "l_suppkey"), F.concat(F.lit("line "), "l_linenumber"))).alias("part"))
    out = stats.ks_two_sample(rows.filter("l_returnflag = 'A'"), rows.filter("l_returnflag = 'R'"), "l_extendedprice", ["part"], EXACT)
    return out.select("part", F.round("ks", 9).alias("ks"), "n_a", "n_b", F.round("p", 8).alias("p"), "method")


GENERATORS = {
    1: frozenset({("f", "s"), ("s", "t"), ("f", "q")}), 2: frozenset({("f", "t"), ("s", "t"), ("q", "t")}), 3: frozenset({("s", "f"), ("f", "q"), ("q", "t")}),
    4: frozenset({("f", "q"), ("s", "q"), ("s", "t")}), 5: frozenset({("q", "f"), ("q", "s"), ("f", "t")}),
}
N, ITERATIONS = 400, 4


def _binned(spark, d):
    return read_table(spark, f"{d}/lineitem.parquet").selectExpr("l_returnflag AS f", "l_linestatus AS s", "l_linenumber AS t", "CAST(ceil(l_quantity / 10) AS INTEGER) AS q")


def _sampled(spark, d):
    rows = _binned(spark, d)
    return rows, generators.sample_generators(stats.contingency(rows, ["f", "s", "t", "q"]), GENERATORS, N, ITERATIONS)


def generator_samples(spark, d):
    """Five generators in four iterations, sampled in one job: what was drawn how often."""
    return _sampled(spark, d)[1].groupBy("dag_id", "iteration", "f", "s", "t", "q").agg(F.count("*").alias("n"))


def generator_winners(spark, d):
    """The generators whose samples came closest to the data most often."""
    rows, sampled = _sampled(spark, d)
    out = generators.generator_winners(generators.compare_generators(rows, sampled, {"t": ["f", "s"], "q": ["f", "s"]}))
    return out.select("dag_id", "times", F.round("mean_tradeoff", 6).alias("mean_tradeoff"))


def guide_draws(spark, d):
    """An order drawn for every customer, orders weighted by their total in cents: a table of as many states as there are orders."""
    orders = read_table(spark, f"{d}/orders.parquet").select(F.lit(0).alias("g"), F.col("o_orderkey").alias("state"), F.round(F.col("o_totalprice") * 100).cast("long").alias("n"))
    guide = generators.guide_table(orders, ["g"])
    customers = read_table(spark, f"{d}/customer.parquet").select("c_custkey", F.lit(0).alias("g"), generators.hash_uniform(F.col("c_custkey")).alias("u"))
    return generators.draw_states(customers, guide, ["g"], "u", "o_orderkey").select("c_custkey", "o_orderkey")


REPLICATES = 16


def _keyed(spark, d):
    rows = read_table(spark, f"{d}/lineitem.parquet").withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rows.select("key", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_linestatus", "l_returnflag", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_tax") * 10 + F.col("l_quantity") / 50).alias("t"))


def stratified_effects(spark, d):
    """Effects by g-computation over strata, with intervals: of a number, and of a nominal column of two values."""
    rows = _keyed(spark, d)
    out = causal.stratified_effect(rows, "l_quantity", "y", ["l_returnflag", "l_linenumber"], "key", REPLICATES)
    out = out.unionByName(causal.stratified_effect(rows, "l_linestatus", "y", ["l_linenumber"], "key", REPLICATES))
    return out.select("feature", "target", *[F.round(c, 7).alias(c) for c in ("effect", "low", "high", "se")], "n", F.round("coverage", 9).alias("coverage"))


CAUSES = frozenset({("l_linenumber", "l_quantity"), ("l_quantity", "y"), ("l_linenumber", "y"), ("l_tax", "t"), ("l_quantity", "t"), ("l_linestatus", "l_discount")})
VALIDATED = ["l_quantity", "l_discount", "l_tax", "l_linestatus", "l_linenumber"]


def causal_validation(spark, d):
    """Effects of five features on two targets, beside what refined forests make of the features, and the flags."""
    rows = _keyed(spark, d)
    model = models.fit_refined(rows, VALIDATED, ("y", "t"), 2, boosting={"maxIter": 5}, key="key", maxDepth=4, numTrees=5)
    predict = lambda df: model.transform(df)
    return validation.validate(rows, CAUSES, ["y", "t"], VALIDATED, predict, "key", repeats=3, reads=VALIDATED)


STEPS = {"q": [10.0, 20.0, 25.0, 35.0], "u": [0.05]}
P_Y = "CASE WHEN {q} <= 10 THEN 8.0 WHEN {q} <= 20 THEN 22.0 WHEN {q} <= 35 THEN 40.0 ELSE 60.0 END + CASE WHEN {u} <= 0.05 THEN 0.0 ELSE 3.0 END"
P_T = "CASE WHEN {q} <= 25 THEN 0.65 ELSE 1.15 END"
SWEPT = (0.1, 4.0)


def staged_forest_grid(spark, d):
    """The reference's grid of 72 forests of up to 500 trees in 3 folds over line items, from 18 fits. No SQL; held against single fits and brute force in the tests."""
    grid = {"trees": [100, 200, 300, 500], "depth": [3, 5, 7], "min_split": [5.0, 10.0, 20.0], "min_child": [1.0, 2.0]}
    return ensembles.staged_grid(_keyed(spark, d), VALIDATED, "t", "key", grid, "forest", max_bins=64)[1]


def staged_boosted_grid(spark, d):
    """Boosted trees with second-order regularisation: 16 settings in 2 folds, from 16 fits. No SQL; held against single fits and brute force in the tests."""
    grid = {"trees": [3, 6], "depth": [2, 3], "eta": [0.1, 0.3], "rows": [0.8, 1.0]}
    return ensembles.staged_grid(_keyed(spark, d), VALIDATED, "t", "key", grid, folds=2, max_bins=64)[1]


def factor_sweep(spark, d):
    """The best factors of two columns in turn, over the whole range, for a model of steps."""
    rows = _keyed(spark, d).withColumnsRenamed({"l_quantity": "q", "l_discount": "u"})
    model = lambda df: df.withColumns({"p_y": F.expr(P_Y.format(q="q", u="u")).cast("double"), "p_t": F.expr(P_T.format(q="q")).cast("double")})
    found, _ = sweeps.greedy_sweep(rows, STEPS, model, [("y", "p_y"), ("t", "p_t")], "r2", *SWEPT, reads=["q", "u"])
    return spark.createDataFrame([(c, *[round(v[k], 9) for k in ("low", "high", "factor", "value")]) for c, v in found.items()], "col string, low double, high double, factor double, value double")


def refined_factor_sweep(spark, d):
    """The best factor of the quantity for forests and boosted trees that refine each other: what no grid can miss. No SQL; held against exploded grids in the tests."""
    rows = _keyed(spark, d)
    features = ["l_quantity", "l_discount", "l_tax"]
    model = models.fit_refined(rows, features, ("y", "t"), 1, boosting={"maxIter": 2, "maxDepth": 3, "maxBins": 8}, numTrees=3, maxDepth=3, maxBins=8)
    rows = rows.withColumn("l_quantity", F.col("l_quantity") * 0.6)  # another domain
    found = sweeps.sweep_factor(rows, "l_quantity", sweeps.thresholds(model, "l_quantity"), lambda df: model.transform(df), [("y", "p_y"), ("t", "p_t")], reads=features)
    return spark.createDataFrame([tuple(float(found[k]) for k in ("low", "high", "factor", "value"))], "low double, high double, factor double, value double")


def isotonic_blocks(spark, d):
    """The isotonic fit of a noisy measure over prices in hundreds: its blocks."""
    rows = read_table(spark, f"{d}/lineitem.parquet").select(F.floor(F.col("l_extendedprice") / 100).alias("x"), (F.col("l_linenumber") + F.col("l_extendedprice") / 50000).alias("y"))
    return isotonic.isotonic_blocks(rows, "x", "y").select("lo", "hi", "n", F.round("mean", 7).alias("mean"))


QUERIES = {f.__name__: f for f in (trio_scores, ks_p_values, generator_samples, generator_winners, guide_draws, stratified_effects, causal_validation, factor_sweep, staged_forest_grid, staged_boosted_grid, refined_factor_sweep, isotonic_blocks)}


def _sweep_sql(col: str, cells: str) -> str:
    """The best stretch of factors of col by trying the middle of every one on the cells (q, u) with their sums."""
    py, pt = P_Y.format(q="q * CASE WHEN '{c}' = 'q' THEN f ELSE 1 END".format(c=col), u="u * CASE WHEN '{c}' = 'u' THEN f ELSE 1 END".format(c=col)), P_T.format(q="q * CASE WHEN '{c}' = 'q' THEN f ELSE 1 END".format(c=col))
    return f"""(SELECT '{col}' AS col, low, high, f AS factor, 1 - (ey / vy + et / vt) / 2 AS value FROM (
  SELECT low, high, f, sum(syy - 2 * sy * py + n * py * py) AS ey, sum(stt - 2 * st * pt + n * pt * pt) AS et FROM (
    SELECT *, {py} AS py, {pt} AS pt FROM {cells}, (
      SELECT low, high, (low + high) / 2 AS f FROM (SELECT low, coalesce(lead(low) OVER (ORDER BY low), {SWEPT[1]}::DOUBLE) AS high FROM (
        SELECT {SWEPT[0]}::DOUBLE AS low UNION SELECT t / {col} FROM {cells}, (SELECT unnest({STEPS[col]}::DOUBLE[]) AS t) WHERE {col} > 0 AND t / {col} > {SWEPT[0]}::DOUBLE AND t / {col} < {SWEPT[1]}::DOUBLE)))) GROUP BY ALL), v
  ORDER BY round(value, 11) DESC, low LIMIT 1)"""


def _trio_sql() -> str:
    names = list(NINE)
    trios = list(dict.fromkeys(tuple(c for c in names if c in graph.nodes_of(d)) for d in TRIO_DAGS.values()))
    pairs = list(dict.fromkeys(p for a, b, c in trios for p in ((a, b), (a, c), (b, c))))
    text = lambda c: f"CAST({c} AS VARCHAR)"
    c3 = " UNION ALL ".join(f"SELECT '{a}{b}{c}' AS t, {text(a)} AS va, {text(b)} AS vb, {text(c)} AS vc, count(*) AS n FROM b GROUP BY {a}, {b}, {c}" for a, b, c in trios)
    c2 = " UNION ALL ".join(f"SELECT '{a}{b}' AS p, {text(a)} AS va, {text(b)} AS vb, count(*) AS n FROM b GROUP BY {a}, {b}" for a, b in pairs)
    c1 = " UNION ALL ".join(f"SELECT '{a}' AS c, {text(a)} AS va, count(*) AS n FROM b GROUP BY {a}" for a in names)
    rows = []
    for k, d in TRIO_DAGS.items():
        t = tuple(c for c in names if c in graph.nodes_of(d))
        rows.append(f"({k}, '{', '.join(f'{p} -> {c}' for p, c in sorted(d))}', '{''.join(t)}', '{t[0]}', '{t[1]}', '{t[2]}', {', '.join(str(cube.family_mask(d, x, t)) for x in t)})")
    pick = lambda m, *xs: f"CASE {m} WHEN 0 THEN {xs[0]} WHEN 1 THEN {xs[1]} WHEN 2 THEN {xs[2]} ELSE {xs[3]} END"
    return f"""
WITH b AS (SELECT {', '.join(f'{v} AS {c}' for c, v in NINE.items())} FROM lineitem), n AS (SELECT count(*)::DOUBLE AS n FROM b),
c3 AS ({c3}), c2 AS ({c2}), c1 AS ({c1}),
g AS (SELECT * FROM (VALUES {', '.join(rows)}) v(dag_id, edges, t, a, b, c, m0, m1, m2)),
s3 AS (SELECT t, sum(n * ln(n)) AS s FROM c3 GROUP BY t), s2 AS (SELECT p, sum(n * ln(n)) AS s FROM c2 GROUP BY p), s1 AS (SELECT c, sum(n * ln(n)) AS s, count(*) AS k FROM c1 GROUP BY c),
w AS (SELECT g.*, s3.s AS sabc, ab.s AS sab, ac.s AS sac, bc.s AS sbc, x.s AS sa, y.s AS sb, z.s AS sc, x.k AS ka, y.k AS kb, z.k AS kc, n.n * ln(n.n) AS s0, n.n AS n
  FROM g JOIN s3 USING (t) JOIN s2 ab ON ab.p = a || b JOIN s2 ac ON ac.p = a || c JOIN s2 bc ON bc.p = b || c JOIN s1 x ON x.c = a JOIN s1 y ON y.c = b JOIN s1 z ON z.c = g.c, n),
l AS (SELECT dag_id, edges, n, {pick('m0', 'sa - s0', 'sab - sb', 'sac - sc', 'sabc - sbc')} + {pick('m1', 'sb - s0', 'sab - sa', 'sbc - sc', 'sabc - sac')} + {pick('m2', 'sc - s0', 'sac - sa', 'sbc - sb', 'sabc - sab')} AS ll,
  CAST((ka - 1) * {pick('m0', '1', 'kb', 'kc', 'kb * kc')} + (kb - 1) * {pick('m1', '1', 'ka', 'kc', 'ka * kc')} + (kc - 1) * {pick('m2', '1', 'ka', 'kb', 'ka * kb')} AS INTEGER) AS k FROM w),
f AS (SELECT g.t, x.va AS va, y.va AS vb, z.va AS vc, x.n AS na, y.n AS nb, z.n AS nc, coalesce(ab.n, 0) AS nab, coalesce(ac.n, 0) AS nac, coalesce(bc.n, 0) AS nbc, coalesce(c3.n, 0) AS nabc
  FROM (SELECT DISTINCT t, a, b, c FROM g) g JOIN c1 x ON x.c = g.a JOIN c1 y ON y.c = g.b JOIN c1 z ON z.c = g.c LEFT JOIN c2 ab ON ab.p = g.a || g.b AND ab.va = x.va AND ab.vb = y.va
  LEFT JOIN c2 ac ON ac.p = g.a || g.c AND ac.va = x.va AND ac.vb = z.va LEFT JOIN c2 bc ON bc.p = g.b || g.c AND bc.va = y.va AND bc.vb = z.va LEFT JOIN c3 ON c3.t = g.t AND c3.va = x.va AND c3.vb = y.va AND c3.vc = z.va),
p AS (SELECT dag_id, nabc / n.n AS e, {pick('m0', 'na / n.n', 'nab / nb', 'nac / nc', 'CASE WHEN nbc > 0 THEN nabc / nbc ELSE 0 END')} * {pick('m1', 'nb / n.n', 'nab / na', 'nbc / nc', 'CASE WHEN nac > 0 THEN nabc / nac ELSE 0 END')} * {pick('m2', 'nc / n.n', 'nac / na', 'nbc / nb', 'CASE WHEN nab > 0 THEN nabc / nab ELSE 0 END')} AS j FROM g JOIN f USING (t), n),
i AS (SELECT dag_id, avg(1 - abs(e - j) / (e + j + 1e-10::DOUBLE)) AS similarity FROM p WHERE e > 0 OR j > 0 GROUP BY dag_id)
SELECT dag_id, edges, k, round(ll, 3) AS ll, round(2 * k - 2 * ll, 3) AS aic, round(ln(n) * k - 2 * ll, 3) AS bic, round(similarity, 6) AS similarity FROM l JOIN i USING (dag_id)"""


def _sample_sql() -> str:
    """Every generator's rows by the textbook: per node a cumulative table of its family, ordered by the state's text."""
    withs, selects = [], []
    for ordinal, (k, d) in enumerate(GENERATORS.items()):
        order, joins = graph.topological_order(d), []
        for i, x in enumerate(order):
            up, name = graph.parents(d, x), f"c{k}{x}"
            keys, part = ", ".join((*up, x)), f"PARTITION BY {', '.join(up)}" if up else ""
            withs.append(f"{name} AS (SELECT {keys}, (sum(n) OVER w - n)::DOUBLE / sum(n) OVER p AS lo, sum(n) OVER w::DOUBLE / sum(n) OVER p AS hi, row_number() OVER ({part} ORDER BY CAST({x} AS VARCHAR) DESC) AS back FROM (SELECT {keys}, count(*) AS n FROM b GROUP BY {keys}) WINDOW w AS ({part} ORDER BY CAST({x} AS VARCHAR) ROWS UNBOUNDED PRECEDING), p AS ({part}))".replace("sum(n) OVER w::DOUBLE", "(sum(n) OVER w)::DOUBLE"))
            met = " AND ".join([*[f"{name}.{p} = c{k}{p}.{p}" for p in up], f"u{i} >= {name}.lo", f"(u{i} < {name}.hi OR {name}.back = 1)"])
            joins.append(f"JOIN {name} ON {met}")
        draws = ", ".join(f"{hash_uniform_sql('CAST(key AS BIGINT)', i)} AS u{i}" for i in range(len(order)))
        selects.append(f"SELECT {k} AS dag_id, r.iteration, r.row, " + ", ".join(f"c{k}{x}.{x}" for x in ("f", "q", "s", "t")) + f" FROM (SELECT row, iteration, {draws} FROM (SELECT row, iteration, ({ordinal * ITERATIONS} + iteration) * {N} + row AS key FROM ids)) r " + " ".join(joins))
    return f"b AS (SELECT l_returnflag AS f, l_linestatus AS s, l_linenumber AS t, CAST(ceil(l_quantity / 10) AS INTEGER) AS q FROM lineitem), ids AS (SELECT CAST(i % {N} AS BIGINT) AS row, CAST(i // {N} AS INTEGER) AS iteration FROM (SELECT unnest(range({N * ITERATIONS})) AS i)), {', '.join(withs)}, x AS ({' UNION ALL '.join(selects)})"


def _response_sql(y: str) -> str:
    return f"""r{y} AS (SELECT f, s, avg({y}) AS v FROM b GROUP BY f, s), m{y} AS (SELECT dag_id, iteration, f, s, avg({y}) AS v FROM x GROUP BY ALL),
j{y} AS (SELECT dag_id, iteration, r.v AS a, m.v AS b FROM m{y} m JOIN r{y} r USING (f, s)), u{y} AS (SELECT dag_id, iteration, a AS v, 1 AS ia, 0 AS ib FROM j{y} UNION ALL SELECT dag_id, iteration, b, 0, 1 FROM j{y}),
k{y} AS (SELECT dag_id, iteration, max(abs(ca / na - cb / nb)) AS ks FROM (SELECT dag_id, iteration, sum(ia) OVER w AS ca, sum(ib) OVER w AS cb, sum(ia) OVER p AS na, sum(ib) OVER p AS nb FROM u{y} WINDOW w AS (PARTITION BY dag_id, iteration ORDER BY v RANGE UNBOUNDED PRECEDING), p AS (PARTITION BY dag_id, iteration)) GROUP BY ALL),
d{y} AS (SELECT dag_id, iteration, mae, ks FROM (SELECT dag_id, iteration, avg(abs(a - b)) AS mae FROM j{y} GROUP BY ALL) JOIN k{y} USING (dag_id, iteration))"""


_SCALED = lambda c: f"CASE WHEN max({c}) OVER i > min({c}) OVER i THEN ({c} - min({c}) OVER i) / (max({c}) OVER i - min({c}) OVER i) ELSE 0 END"

_WEIGHT = " + ".join(f"CAST(u >= {c!r}::DOUBLE AS INTEGER)" for c in causal.POISSON)
_DRAWN = " UNION ALL ".join(["SELECT *, 0 AS r, 1 AS w FROM b", *[f"SELECT * EXCLUDE u, {_WEIGHT} AS w FROM (SELECT *, {i} AS r, {hash_uniform_sql('key', i)} AS u FROM b)" for i in range(1, REPLICATES + 1)]])


def _interval_sql(kind: str, x: str, strata: str) -> str:
    num, den, tells = {
        "slope": ("sxy - sx * sy / sw", "sxx - sx * sx / sw", "sw > 0 AND sxx - sx * sx / sw > 1e-9"),
        "contrast": ("sw * (sxy / nullif(sx, 0) - (sy - sxy) / nullif(sw - sx, 0))", "sw", "sx > 0 AND sx < sw"),
    }[kind]
    return f"""SELECT '{x}' AS feature, 'y' AS target, round(max(e) FILTER (WHERE r = 0), 7) AS effect, round(quantile_cont(e, 0.025) FILTER (WHERE r > 0), 7) AS low, round(quantile_cont(e, 0.975) FILTER (WHERE r > 0), 7) AS high, round(stddev_samp(e) FILTER (WHERE r > 0), 7) AS se,
  CAST(max(w) FILTER (WHERE r = 0) AS BIGINT) AS n, round(max(told / w) FILTER (WHERE r = 0), 9) AS coverage FROM (
  SELECT r, sum(CASE WHEN {tells} THEN {num} END) / sum(CASE WHEN {tells} THEN {den} END) AS e, sum(CASE WHEN {tells} THEN sw ELSE 0 END) AS told, sum(sw) AS w FROM (
    SELECT r, {strata}, sum(w)::DOUBLE AS sw, sum(w * {kind}) AS sx, sum(w * y) AS sy, sum(w * {kind} * {kind}) AS sxx, sum(w * {kind} * y) AS sxy FROM drawn GROUP BY r, {strata}) GROUP BY r)"""


SQL = {
    "factor_sweep": f"""
WITH g AS (SELECT l_quantity AS q, l_discount AS u, count(*) AS n, sum(l_extendedprice / 1000) AS sy, sum((l_extendedprice / 1000) ** 2) AS syy, sum(l_tax * 10 + l_quantity / 50) AS st, sum((l_tax * 10 + l_quantity / 50) ** 2) AS stt FROM lineitem GROUP BY ALL),
v AS (SELECT count(*) * var_pop(l_extendedprice / 1000) AS vy, count(*) * var_pop(l_tax * 10 + l_quantity / 50) AS vt FROM lineitem),
a AS {_sweep_sql('q', 'g')}, h AS (SELECT g.* REPLACE (q * factor AS q) FROM g, a), b AS {_sweep_sql('u', 'h')}
SELECT col, round(low, 9) AS low, round(high, 9) AS high, round(factor, 9) AS factor, round(value, 9) AS value FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
    "isotonic_blocks": """
WITH p AS (SELECT floor(l_extendedprice / 100) AS x, count(*) AS n, sum(l_linenumber + l_extendedprice / 50000) AS s FROM lineitem GROUP BY 1),
c AS (SELECT x, row_number() OVER (ORDER BY x) AS i, n, sum(n) OVER w AS cn, sum(s) OVER w AS cs, sum(n) OVER w - n AS bn, sum(s) OVER w - s AS bs FROM p WINDOW w AS (ORDER BY x)),
m AS (SELECT a.i AS a, b.i AS b, (b.cs - a.bs) / (b.cn - a.bn) AS mean FROM c a JOIN c b ON b.i >= a.i),
l AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS least FROM m),
f AS (SELECT i, max(least) AS fit FROM l GROUP BY i)
SELECT min(x) AS lo, max(x) AS hi, CAST(sum(n) AS BIGINT) AS n, round(avg(fit), 7) AS mean FROM c JOIN f USING (i) GROUP BY round(fit, 9)""",
    "stratified_effects": f"""WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS key, l_quantity - 25 AS slope, CAST(l_linestatus = 'O' AS INTEGER) AS contrast, l_extendedprice / 1000 AS y, l_returnflag, l_linenumber FROM lineitem),
drawn AS ({_DRAWN}) {_interval_sql('slope', 'l_quantity', 'l_returnflag, l_linenumber')} UNION ALL {_interval_sql('contrast', 'l_linestatus', 'l_linenumber')}""",
    "generator_samples": f"WITH {_sample_sql()} SELECT dag_id, iteration, f, s, t, q, count(*) AS n FROM x GROUP BY ALL",
    "generator_winners": f"""
WITH {_sample_sql()}, {_response_sql('t')}, {_response_sql('q')},
m AS (SELECT dag_id, iteration, avg(mae) AS mae, avg(ks) AS ks FROM (SELECT * FROM dt UNION ALL SELECT * FROM dq) GROUP BY ALL),
o AS (SELECT dag_id, iteration, round({_SCALED('mae')} + {_SCALED('ks')}, 9) AS t FROM m WINDOW i AS (PARTITION BY iteration)),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY iteration ORDER BY t, dag_id) AS rank FROM o) WHERE rank <= 3)
SELECT dag_id, count(*) AS times, round(avg(t), 6) AS mean_tradeoff FROM h GROUP BY dag_id ORDER BY times DESC, dag_id LIMIT 3""",
    "guide_draws": f"""
WITH c AS (SELECT o_orderkey, (sum(n) OVER w - n)::DOUBLE / sum(n) OVER () AS lo, (sum(n) OVER w)::DOUBLE / sum(n) OVER () AS hi, row_number() OVER (ORDER BY o_orderkey DESC) AS back
  FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS n FROM orders) WINDOW w AS (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)),
u AS (SELECT c_custkey, {hash_uniform_sql('c_custkey', 0)} AS u FROM customer)
SELECT c_custkey, o_orderkey FROM u ASOF JOIN c ON u.u >= c.lo""",
    "trio_scores": _trio_sql(),
    "ks_p_values": f"""
WITH RECURSIVE u AS (SELECT unnest(['supplier ' || l_suppkey, 'line ' || l_linenumber]) AS part, l_extendedprice AS v, CAST(l_returnflag = 'A' AS INTEGER) AS a, CAST(l_returnflag = 'R' AS INTEGER) AS b FROM lineitem WHERE l_returnflag IN ('A', 'R')),
k AS (SELECT part, max(abs(ca / na - cb / nb)) AS ks, CAST(max(na) AS BIGINT) AS n_a, CAST(max(nb) AS BIGINT) AS n_b FROM (
  SELECT part, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER t AS na, sum(b) OVER t AS nb FROM u WINDOW w AS (PARTITION BY part ORDER BY v RANGE UNBOUNDED PRECEDING), t AS (PARTITION BY part)) WHERE na > 0 AND nb > 0 GROUP BY part),
g AS (SELECT part, least(n_a, n_b) AS m, greatest(n_a, n_b) AS n, lcm(n_a, n_b) AS l, CAST(round(ks * lcm(n_a, n_b)) AS BIGINT) AS h FROM k WHERE greatest(n_a, n_b) <= {EXACT}),
r AS (SELECT part, m, n, l, h, 0::BIGINT AS s, list_transform(range(m + 1), lambda i: CASE WHEN h <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS q FROM g
  UNION ALL SELECT part, m, n, l, h, s + 1, list_transform(range(m + 1), lambda i: CASE WHEN i > s + 1 OR s + 1 - i > n THEN 0.0::DOUBLE WHEN abs(i * (l // m) - (s + 1 - i) * (l // n)) >= h THEN 1.0::DOUBLE ELSE (i * CASE WHEN i > 0 THEN q[i] ELSE 0 END + (s + 1 - i) * q[i + 1]) / (s + 1)::DOUBLE END) FROM r WHERE s < m + n),
x AS (SELECT part, q[m + 1] AS p FROM r WHERE s = m + n),
z AS (SELECT part, ks * sqrt(n_a::DOUBLE * n_b / (n_a + n_b)) AS z FROM k),
y AS (SELECT part, CASE WHEN z < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 100), lambda j: CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * j * j * z * z))))) END AS p FROM z)
SELECT k.part, round(ks, 9) AS ks, n_a, n_b, round(coalesce(x.p, y.p), 8) AS p, CASE WHEN x.p IS NULL THEN 'asymptotic' ELSE 'exact' END AS method FROM k LEFT JOIN x USING (part) JOIN y USING (part)""",
}
