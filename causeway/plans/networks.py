"""Queries on Bayesian networks and graph structure. Graphs over three nominal columns of line items; structure jobs on a fixed set of graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import windows
from causeway.functions.columns import hash_uniform_sql
from causeway.functions.scratch import scratch_path
from causeway.operators import bayes, graph, stats
from causeway.sources import logs
from causeway.sources.tables import read_table

NODES = ["f", "s", "t"]
SEARCHED = ["f", "s", "t", "q"]
DAGS = dict(enumerate(bayes.enumerate_dags(NODES), 1))

def _nominal(spark, d, extra: bool = False):
    rows = read_table(spark, f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), F.col("l_linenumber").alias("t"), *([F.ceil(F.col("l_quantity") / 10).cast("int").alias("q")] if extra else []))
    return rows


def dag_scores(spark, d):
    out = bayes.score_dags(_nominal(spark, d), DAGS, NODES)
    return out.select("dag_id", "edges", "k", F.round("ll", 3).alias("ll"), F.round("aic", 3).alias("aic"), F.round("bic", 3).alias("bic"), F.round("similarity", 6).alias("similarity"))


def dag_ranking(spark, d):
    out = bayes.rank_dags(bayes.score_dags(_nominal(spark, d), DAGS, NODES, with_similarity=False), 10)
    return out.select("dag_id", F.round("bic", 2).alias("bic"))


def factorised_similarity(spark, d):
    c = stats.contingency(_nominal(spark, d), NODES)
    dag = frozenset({("f", "t"), ("s", "t")})
    return bayes.similarity(c, dag).select(F.round("similarity", 6).alias("similarity"))


def factorised_joint(spark, d):
    c = stats.contingency(_nominal(spark, d), NODES)
    return bayes.factorised_joint(c, frozenset({("f", "s"), ("f", "t")})).select("f", "s", "t", F.round("p", 9).alias("p"))


def param_counts(spark, d):
    cards = bayes.cardinalities(stats.contingency(_nominal(spark, d), NODES), NODES)
    return spark.createDataFrame([(k, bayes.parameter_count(x, cards)) for k, x in DAGS.items()], "dag_id int, k int")


def hill_climb_dag(spark, d):
    counts = stats.contingency(_nominal(spark, d, True), SEARCHED).persist()
    scores = bayes.FamilyScores(counts, SEARCHED, alpha=1.0)
    found, score = bayes.expand_dag(scores, frozenset({("f", "s")}), {(a, b) for a in SEARCHED for b in SEARCHED if a != b})
    counts.unpersist()
    return spark.createDataFrame([(p, c, round(score, 3)) for p, c in sorted(found)], "parent string, child string, bic double")


def laplace_log_likelihood(spark, d):
    counts = stats.contingency(_nominal(spark, d, True), SEARCHED)
    s = bayes.FamilyScores(counts, SEARCHED, alpha=1.0).score({("f", "s"), ("s", "t")}, SEARCHED)
    return spark.createDataFrame([(round(s["ll"], 3), int(s["k"]), round(s["bic"], 3))], "ll double, k int, bic double")


def joint_entropy(spark, d):
    sums = stats.set_sums(stats.contingency(_nominal(spark, d), NODES), [frozenset(v) for v in stats.powerset(NODES) if v], NODES)
    bits = (F.log("total") - F.col("s") / F.col("total")) / F.log(F.lit(2.0))
    return sums.select(F.array_join("names", ",").alias("names"), F.round(bits, 6).alias("bits"), "cells")


def cmi(spark, d):
    out = stats.conditional_mutual_information(_nominal(spark, d), [("f", "s", ()), ("f", "s", ("t",)), ("f", "t", ("s",))])
    return out.select("x", "y", F.array_join("given", ",").alias("given"), F.round("cmi", 6).alias("cmi"))


def cmi_powerset(spark, d):
    pairs = [(x, y, z) for i, x in enumerate(SEARCHED) for y in SEARCHED[i + 1 :] for z in stats.powerset(c for c in SEARCHED if c not in (x, y))]
    out = stats.conditional_mutual_information(_nominal(spark, d, True), pairs)
    return out.select("x", "y", F.array_join("given", ",").alias("given"), F.round("cmi", 6).alias("cmi"))


def _ranked(spark, d):
    """The ten graphs that fit the line items best."""
    return bayes.rank_dags(bayes.score_dags(_nominal(spark, d), DAGS, NODES, with_similarity=False), 10).select("dag_id")


def _learnt(spark, d):
    """Their edges."""
    return graph.edge_table(spark, DAGS).join(F.broadcast(_ranked(spark, d)), "dag_id", "left_semi")  # ten rows


def _graphs(spark, d) -> dict:
    """The same on the driver: ten graphs of three nodes."""
    return {k: DAGS[k] for k in sorted(r["dag_id"] for r in _ranked(spark, d).collect())}


def dag_structures(spark, d):
    return graph.triples(_learnt(spark, d))


def v_structures(spark, d):
    return graph.v_structures(_learnt(spark, d))


def equivalence_classes(spark, d):
    return graph.equivalence_classes(_learnt(spark, d))


def simple_paths(spark, d):
    rows = [(k, ">".join(p), graph.classify_path(x, p)) for k, x in _graphs(spark, d).items() for p in graph.simple_paths(x, "f", "t")]
    return spark.createDataFrame(rows, "dag_id int, path string, kind string")


def backdoor_sets(spark, d):
    """Of the graphs in which t is no parent of f."""
    some = {k: x for k, x in _graphs(spark, d).items() if ("t", "f") not in x}
    rows = [(k, graph.feature_role(x, "f", "t"), ",".join(graph.minimal_backdoor_set(x, "f", "t") or ()), len(graph.backdoor_sets(x, "f", "t")), len(graph.causal_paths(x, "f", "t"))) for k, x in some.items()]
    return spark.createDataFrame(rows, "dag_id int, role string, minimal string, n_sets int, n_causal_paths int")


def ancestral_sample(spark, d):
    counts = stats.contingency(_nominal(spark, d), NODES)
    return bayes.ancestral_sample(spark, counts, frozenset({("f", "s"), ("s", "t")}), 500)


def sampled_against_real(spark, d):
    rows = _nominal(spark, d)
    sample = bayes.ancestral_sample(spark, stats.contingency(rows, NODES), frozenset({("f", "s"), ("s", "t")}), 500)
    return windows.top_k(sample.groupBy("f", "s").agg(F.count("*").alias("n"), F.round(F.avg("t"), 6).alias("mean_t")), 5, F.desc("n"), "f", "s")


COLUMNS = ["f", "p", "q", "s", "t"]
BANNED = bayes.outcome_constraints(["t"], ["f", "s"])
LARGER = frozenset({("f", "s"), ("s", "t"), ("f", "q"), ("q", "t")})
FORCED = ("f", "t")
#: What names winners: each metric's three best graphs, ties to the smaller id.
METRICS = {"bic": "bic", "aic": "aic", "ll": "-ll", "similarity": "-similarity"}


def whitelist_edges(spark, d):
    return spark.createDataFrame(sorted(bayes.whitelist(_graphs(spark, d).values())), "parent string, child string")


def forced_graphs(spark, d):
    """Every graph with a forced edge, where that makes no cycle, and the graphs that are the same with it."""
    forced = {}
    for k, x in _graphs(spark, d).items():
        try:
            forced[k] = graph.forced_edges(x, [FORCED])
        except ValueError:
            continue
    same = {k: ",".join(map(str, g)) for g in graph.duplicate_dags(forced) for k in g}
    return spark.createDataFrame([(k, len(x), same.get(k, "")) for k, x in forced.items()], "dag_id int, n_edges long, same_as string")


def path_information(spark, d):
    out = bayes.path_information(_nominal(spark, d, True), LARGER)
    return out.select("path", "given", F.round("cmi", 6).alias("cmi"), "d_separated")


def winner_edges(spark, d):
    scored = dag_scores(spark, d).persist()
    named = reduce(DataFrame.unionByName, [windows.top_k(scored, 3, F.expr(m), "dag_id").select("dag_id") for m in METRICS.values()])
    return bayes.winner_edges(graph.edge_table(spark, DAGS), named, 3)


def scored_log(spark, d):
    """Scored graphs written as log lines and read back."""
    path = f"{scratch_path(spark, 'scored')}.log"
    scored = bayes.score_dags(_nominal(spark, d), DAGS, NODES, with_similarity=False).withColumn("similarity", F.lit(0.5))
    logs.dag_lines(scored).write.text(path)
    back = logs.read_scored_dags(spark, path)
    return back.select(F.col("dag_id").cast("int").alias("dag_id"), F.array_join(F.transform("edges", lambda e: F.concat_ws(" -> ", e["parent"], e["child"])), ", ").alias("edges"), "similarity", F.round("ll", 1).alias("ll"), F.round("bic", 1).alias("bic"))


def dag_blocks(spark, d):
    """Blocks of a graph log, read as edges with their score."""
    path = f"{scratch_path(spark, 'blocks')}.log"
    text = "\n".join(f"DAG {k}:\nEdges: [{', '.join(repr(e) for e in sorted(x))}]\nScore: {k}.5\n------" for k, x in _graphs(spark, d).items())
    spark.createDataFrame([(text,)], "value string").write.text(path)
    blocks = logs.read_dag_blocks(spark, path)
    return logs.edge_rows(blocks).join(blocks.select("dag_id", "score"), "dag_id")


QUERIES = {f.__name__: f for f in (dag_scores, dag_ranking, factorised_similarity, factorised_joint, param_counts, hill_climb_dag, laplace_log_likelihood, joint_entropy, cmi, cmi_powerset, dag_structures, v_structures, equivalence_classes, simple_paths, backdoor_sets, ancestral_sample, sampled_against_real, whitelist_edges, forced_graphs, path_information, winner_edges, scored_log, dag_blocks)}

_BASE = "b AS (SELECT l_returnflag AS f, l_linestatus AS s, l_linenumber AS t, CAST(ceil(l_quantity / 10) AS INTEGER) AS q FROM lineitem)"
_N = "(SELECT count(*) FROM b)::DOUBLE"


def _family(child: str, given: tuple[str, ...]) -> str:
    return f"p_{child}_" + "".join(given)


def _family_sql(child: str, given: tuple[str, ...]) -> str:
    keys = ", ".join((*given, child))
    total = f"sum(count(*)) OVER (PARTITION BY {', '.join(given)})" if given else _N
    return f"{_family(child, given)} AS (SELECT {keys}, count(*) AS n, count(*)::DOUBLE / ({total})::DOUBLE AS p FROM b GROUP BY {keys})"


def _cards(cols: list[str]) -> str:
    return "card AS (SELECT " + ", ".join(f"count(DISTINCT {c}) AS k{c}" for c in cols) + " FROM b)"


def _k(dag, nodes=NODES) -> str:
    return " + ".join("(" + " * ".join([f"(k{n} - 1)", *[f"k{p}" for p in graph.parents(dag, n)]]) + ")" for n in nodes)


def _joint_sql(dag) -> str:
    """The product of the tables, each joined on its parents."""
    order = graph.topological_order(dag)
    out = f"SELECT {order[0]}, p FROM {_family(order[0], ())}"
    have = [order[0]]
    for n in order[1:]:
        given = graph.parents(dag, n)
        on = " AND ".join(f"x.{g} = y.{g}" for g in given) or "TRUE"
        out = f"SELECT {', '.join('x.' + h for h in have)}, y.{n}, x.p * y.p AS p FROM ({out}) x JOIN {_family(n, given)} y ON {on}"
        have.append(n)
    return out


def _similarity_sql(dag) -> str:
    return f"SELECT avg(1 - abs(coalesce(e.p, 0) - coalesce(j.p, 0)) / (coalesce(e.p, 0) + coalesce(j.p, 0) + 1e-10::DOUBLE)) FROM (SELECT f, s, t, count(*) / {_N} AS p FROM b GROUP BY f, s, t) e FULL JOIN ({_joint_sql(dag)}) j ON e.f = j.f AND e.s = j.s AND e.t = j.t"


_FAMILIES = sorted({(n, graph.parents(x, n)) for x in DAGS.values() for n in NODES})
_WITH = "WITH " + ", ".join([_BASE, _cards(NODES), *[_family_sql(*f) for f in _FAMILIES]])


def _ll(dag, nodes=NODES) -> str:
    return " + ".join(f"(SELECT sum(n * ln(p)) FROM {_family(n, graph.parents(dag, n))})" for n in nodes)


def _edges(dag) -> str:
    return ", ".join(f"{p} -> {c}" for p, c in sorted(dag))


_SCORED = " UNION ALL ".join(f"SELECT {k} AS dag_id, '{_edges(x)}' AS edges, CAST({_k(x)} AS INTEGER) AS k, {_ll(x)} AS ll, ({_similarity_sql(x)}) AS similarity FROM card" for k, x in DAGS.items())
_EDGES = "(SELECT * FROM (VALUES " + ", ".join(f"({k}, '{p}', '{c}')" for k, x in DAGS.items() for p, c in sorted(x)) + ") v(dag_id, parent, child))"
_LEARNT = f"{_WITH.removeprefix('WITH ')}, scored AS ({_SCORED}), ranked AS (SELECT dag_id FROM scored ORDER BY round(ln({_N}) * k - 2 * ll, 2), round(2 * k - 2 * ll, 2), round(ll, 2) DESC, dag_id LIMIT 10), e AS (SELECT * FROM {_EDGES} WHERE dag_id IN (SELECT dag_id FROM ranked))"
_H = lambda cols: f"(SELECT -sum(p * log2(p)) FROM (SELECT count(*) / {_N} AS p FROM b GROUP BY {', '.join(cols)}))" if cols else "0"


def _cmi(x, y, z) -> str:
    return f"SELECT '{x}' AS x, '{y}' AS y, '{','.join(z)}' AS given, round({_H([x, *z])} + {_H([y, *z])} - {_H([x, y, *z])} - {_H(list(z))}, 6) + 0 AS cmi"


def _u(i: int) -> str:
    """The i-th stream of uniform numbers at key r."""
    return hash_uniform_sql("CAST(r AS BIGINT)", i)


def _cdf(child: str, given: tuple[str, ...]) -> str:
    part = f"PARTITION BY {', '.join(given)}" if given else ""
    return f"c_{child} AS (SELECT *, sum(p) OVER ({part} ORDER BY {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo0, sum(p) OVER ({part} ORDER BY {child} ROWS UNBOUNDED PRECEDING) AS hi0, row_number() OVER ({part} ORDER BY {child} DESC) AS back FROM {_family(child, given)})"


_SAMPLE = f"""WITH {_BASE}, {_family_sql('f', ())}, {_family_sql('s', ('f',))}, {_family_sql('t', ('s',))}, {_cdf('f', ())}, {_cdf('s', ('f',))}, {_cdf('t', ('s',))},
n AS (SELECT r, {_u(0)} AS u0, {_u(1)} AS u1, {_u(2)} AS u2 FROM (SELECT unnest(range(500)) AS r)),
x AS (SELECT n.r AS row, c_f.f, c_s.s, c_t.t FROM n
  JOIN c_f ON u0 >= coalesce(c_f.lo0, 0) AND (u0 < c_f.hi0 OR c_f.back = 1)
  JOIN c_s ON c_s.f = c_f.f AND u1 >= coalesce(c_s.lo0, 0) AND (u1 < c_s.hi0 OR c_s.back = 1)
  JOIN c_t ON c_t.s = c_s.s AND u2 >= coalesce(c_t.lo0, 0) AND (u2 < c_t.hi0 OR c_t.back = 1))"""
_TRIPLES = """
SELECT e.dag_id, 'chain' AS kind, e.parent AS a, e.child AS mid, f.child AS b FROM e JOIN e f ON e.dag_id = f.dag_id AND e.child = f.parent
UNION SELECT e.dag_id, 'fork', e.child, e.parent, f.child FROM e JOIN e f ON e.dag_id = f.dag_id AND e.parent = f.parent AND e.child < f.child
UNION SELECT e.dag_id, 'collider', e.parent, e.child, f.parent FROM e JOIN e f ON e.dag_id = f.dag_id AND e.child = f.child AND e.parent < f.parent"""
_V = f"v AS (SELECT t.dag_id, a, mid, b FROM ({_TRIPLES}) t WHERE kind = 'collider' AND NOT EXISTS (SELECT 1 FROM e WHERE e.dag_id = t.dag_id AND least(parent, child) = t.a AND greatest(parent, child) = t.b))"
_SEARCH_PAIRS = [(x, y, z) for i, x in enumerate(SEARCHED) for y in SEARCHED[i + 1 :] for z in stats.powerset(c for c in SEARCHED if c not in (x, y))]


def _smoothed(child: str, given: tuple[str, ...]) -> str:
    total = f"sum(count(*)) OVER (PARTITION BY {', '.join(given)})" if given else _N
    return f"(SELECT sum(n * ln((n + 1) / (total + k{child}))) FROM (SELECT count(*)::DOUBLE AS n, ({total})::DOUBLE AS total FROM b GROUP BY {', '.join((*given, child))}))"


_LAPLACE = " + ".join(_smoothed(n, graph.parents({("f", "s"), ("s", "t")}, n)) for n in SEARCHED)
_PATHS = [(p, z) for i, x in enumerate(sorted(SEARCHED)) for y in sorted(SEARCHED)[i + 1 :] for p in graph.simple_paths(LARGER, x, y) if len(p) > 2 for z in stats.powerset(p[1:-1])]


def _path_sql(p: tuple[str, ...], z: tuple[str, ...]) -> str:
    given = tuple(sorted(z))
    return f"SELECT '{'>'.join(p)}' AS path, given, cmi, cmi < 1e-5 AS d_separated FROM ({_cmi(p[0], p[-1], given)})"


SQL = {
    "whitelist_edges": f"WITH {_LEARNT} SELECT DISTINCT parent, child FROM e",
    "forced_graphs": f"""WITH RECURSIVE {_LEARNT},
r AS (SELECT dag_id, child AS x FROM e WHERE parent = 't' UNION SELECT r.dag_id, e.child FROM r JOIN e ON e.dag_id = r.dag_id AND e.parent = r.x),
n AS (SELECT dag_id, parent, child FROM e UNION SELECT dag_id, 'f', 't' FROM e),
k AS (SELECT dag_id, count(*) AS n_edges, string_agg(parent || child, ' ' ORDER BY parent, child) AS own FROM n WHERE dag_id NOT IN (SELECT dag_id FROM r WHERE x = 'f') GROUP BY dag_id)
SELECT dag_id, n_edges, CASE WHEN count(*) OVER (PARTITION BY own) > 1 THEN string_agg(CAST(dag_id AS VARCHAR), ',') OVER (PARTITION BY own ORDER BY dag_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE '' END AS same_as FROM k""",
    "path_information": f"WITH {_BASE} " + " UNION ALL ".join(_path_sql(p, z) for p, z in _PATHS),
    "winner_edges": f"{_WITH}, y AS ({_SCORED}), z AS (SELECT dag_id, round(ll, 3) AS ll, round(2 * k - 2 * ll, 3) AS aic, round(ln({_N}) * k - 2 * ll, 3) AS bic, round(similarity, 6) AS similarity FROM y), w AS (" + " UNION ALL ".join(f"SELECT dag_id FROM (SELECT dag_id FROM z ORDER BY {m}, dag_id LIMIT 3)" for m in METRICS.values()) + f") SELECT * FROM {_EDGES} WHERE dag_id IN (SELECT dag_id FROM w GROUP BY dag_id ORDER BY count(*) DESC, dag_id LIMIT 3)",
    "scored_log": f"{_WITH}, z AS ({_SCORED}) SELECT dag_id, edges, 0.5::DOUBLE AS similarity, round(round(ll, 2), 1) AS ll, round(round(ln({_N}) * k - 2 * ll, 2), 1) AS bic FROM z",
    "dag_blocks": f"WITH {_LEARNT} SELECT dag_id, parent, child, dag_id + 0.5::DOUBLE AS score FROM e",
    "dag_scores": f"{_WITH}, z AS ({_SCORED}) SELECT dag_id, edges, k, round(ll, 3) AS ll, round(2 * k - 2 * ll, 3) AS aic, round(ln({_N}) * k - 2 * ll, 3) AS bic, round(similarity, 6) AS similarity FROM z",
    "dag_ranking": f"{_WITH}, z AS ({_SCORED}) SELECT dag_id, round(ln({_N}) * k - 2 * ll, 2) AS bic FROM z ORDER BY 2, round(2 * k - 2 * ll, 2), round(ll, 2) DESC, dag_id LIMIT 10",
    "factorised_similarity": f"WITH {_BASE}, {_family_sql('f', ())}, {_family_sql('s', ())}, {_family_sql('t', ('f', 's'))} SELECT round(({_similarity_sql(frozenset({('f', 't'), ('s', 't')}))}), 6) AS similarity",
    "factorised_joint": f"WITH {_BASE}, {_family_sql('f', ())}, {_family_sql('s', ('f',))}, {_family_sql('t', ('f',))} SELECT f, s, t, round(p, 9) AS p FROM ({_joint_sql(frozenset({('f', 's'), ('f', 't')}))})",
    "param_counts": f"WITH {_BASE}, {_cards(NODES)} " + " UNION ALL ".join(f"SELECT {k} AS dag_id, CAST({_k(x)} AS INTEGER) AS k FROM card" for k, x in DAGS.items()),
    "laplace_log_likelihood": f"WITH {_BASE}, {_cards(SEARCHED)}, z AS (SELECT {_LAPLACE} AS ll, CAST({_k({('f', 's'), ('s', 't')}, SEARCHED)} AS INTEGER) AS k FROM card) SELECT round(ll, 3) AS ll, k, round(ln({_N}) * k - 2 * ll, 3) AS bic FROM z",
    "joint_entropy": f"WITH {_BASE} " + " UNION ALL ".join(f"SELECT '{','.join(v)}' AS names, round(-sum(p * log2(p)), 6) AS bits, count(*) AS cells FROM (SELECT count(*) / {_N} AS p FROM b GROUP BY {', '.join(v)})" for v in stats.powerset(NODES) if v),
    "cmi": f"WITH {_BASE} " + " UNION ALL ".join(_cmi(*p) for p in [("f", "s", ()), ("f", "s", ("t",)), ("f", "t", ("s",))]),
    "cmi_powerset": f"WITH {_BASE} " + " UNION ALL ".join(_cmi(*p) for p in _SEARCH_PAIRS),
    "dag_structures": f"WITH {_LEARNT} {_TRIPLES}",
    "v_structures": f"WITH {_LEARNT}, {_V} SELECT * FROM v",
    "equivalence_classes": f"""WITH {_LEARNT}, {_V},
k AS (SELECT dag_id, (SELECT string_agg(x, ';' ORDER BY x) FROM (SELECT DISTINCT least(parent, child) || '-' || greatest(parent, child) AS x FROM e WHERE e.dag_id = d.dag_id)) AS sk, (SELECT string_agg(a || '>' || mid || '>' || b, ';' ORDER BY a, mid, b) FROM v WHERE v.dag_id = d.dag_id) AS vs FROM (SELECT DISTINCT dag_id FROM e) d)
SELECT CAST(row_number() OVER (ORDER BY min(dag_id)) AS INTEGER) AS class_id, min(dag_id) AS representative, string_agg(CAST(dag_id AS VARCHAR), ',' ORDER BY dag_id) AS dag_ids FROM k GROUP BY sk, coalesce(vs, '')""",
    "simple_paths": f"""WITH RECURSIVE {_LEARNT},
u AS (SELECT dag_id, parent AS x, child AS y FROM e UNION SELECT dag_id, child, parent FROM e),
w AS (SELECT DISTINCT dag_id, ['f'] AS p FROM e UNION ALL SELECT w.dag_id, list_append(p, u.y) FROM w JOIN u ON u.dag_id = w.dag_id AND u.x = p[len(p)] AND NOT list_contains(p, u.y) AND p[len(p)] <> 't'),
f AS (SELECT * FROM w WHERE p[len(p)] = 't'),
i AS (SELECT f.*, EXISTS (SELECT 1 FROM e WHERE e.dag_id = f.dag_id AND parent = p[1] AND child = p[2]) AS fw1, EXISTS (SELECT 1 FROM e WHERE e.dag_id = f.dag_id AND parent = p[2] AND child = p[3]) AS fw2 FROM f)
SELECT dag_id, array_to_string(p, '>') AS path, CASE WHEN len(p) = 2 THEN 'edge' WHEN len(p) > 3 THEN 'longer' WHEN fw1 = fw2 THEN 'chain' WHEN fw1 THEN 'collider' ELSE 'fork' END AS kind FROM i""",
    "backdoor_sets": f"""WITH RECURSIVE {_LEARNT.replace(', e AS (', ', e0 AS (')}, e AS (SELECT * FROM e0 WHERE dag_id NOT IN (SELECT dag_id FROM e0 WHERE parent = 't' AND child = 'f')),
u AS (SELECT dag_id, parent AS x, child AS y FROM e UNION SELECT dag_id, child, parent FROM e),
w AS (SELECT DISTINCT dag_id, ['f'] AS p FROM e UNION ALL SELECT w.dag_id, list_append(p, u.y) FROM w JOIN u ON u.dag_id = w.dag_id AND u.x = p[len(p)] AND NOT list_contains(p, u.y) AND p[len(p)] <> 't'),
f AS (SELECT * FROM w WHERE p[len(p)] = 't'),
r AS (SELECT dag_id, parent AS x, child AS y FROM e UNION SELECT r.dag_id, r.x, e.child FROM r JOIN e ON e.dag_id = r.dag_id AND e.parent = r.y),
m AS (SELECT g.dag_id, v.s FROM (SELECT DISTINCT dag_id FROM e) g, (VALUES (CAST([] AS VARCHAR[])), (['s'])) v(s)),
ok AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.dag_id = m.dag_id AND r.x = 'f' AND list_contains(m.s, r.y))),
k AS (SELECT f.dag_id, f.p, unnest(range(2, len(f.p))) AS k FROM f JOIN e ON e.dag_id = f.dag_id AND e.parent = f.p[2] AND e.child = f.p[1]),
t AS (SELECT k.dag_id, k.p, k.p[k.k] AS mid, l.parent IS NOT NULL AND n.parent IS NOT NULL AS collider FROM k
  LEFT JOIN e l ON l.dag_id = k.dag_id AND l.parent = k.p[k.k - 1] AND l.child = k.p[k.k] LEFT JOIN e n ON n.dag_id = k.dag_id AND n.parent = k.p[k.k + 1] AND n.child = k.p[k.k]),
below AS (SELECT dag_id, x, list(y) AS ys FROM r GROUP BY dag_id, x),
z AS (SELECT ok.dag_id, ok.s, t.p, bool_or(CASE WHEN t.collider THEN NOT list_contains(ok.s, t.mid) AND NOT list_has_any(ok.s, coalesce(below.ys, [])) ELSE list_contains(ok.s, t.mid) END) AS shut
  FROM ok JOIN t ON t.dag_id = ok.dag_id LEFT JOIN below ON below.dag_id = t.dag_id AND below.x = t.mid GROUP BY 1, 2, 3),
good AS (SELECT * FROM ok WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.dag_id = ok.dag_id AND z.s = ok.s AND NOT z.shut)),
best AS (SELECT dag_id, array_to_string(s, ',') AS minimal, row_number() OVER (PARTITION BY dag_id ORDER BY len(s), array_to_string(s, ',')) AS nth, count(*) OVER (PARTITION BY dag_id) AS n_sets FROM good),
direct AS (SELECT f.dag_id, f.p FROM f WHERE (SELECT count(*) FROM (SELECT unnest(range(1, len(f.p))) AS i) q JOIN e ON e.dag_id = f.dag_id AND e.parent = f.p[q.i] AND e.child = f.p[q.i + 1]) = len(f.p) - 1)
SELECT b.dag_id, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.dag_id = b.dag_id AND parent = 'f' AND child = 't') THEN 'direct' WHEN EXISTS (SELECT 1 FROM r WHERE r.dag_id = b.dag_id AND x = 'f' AND y = 't') THEN 'indirect' ELSE 'unconnected' END AS role,
  b.minimal, CAST(b.n_sets AS INTEGER) AS n_sets, CAST((SELECT count(*) FROM direct WHERE direct.dag_id = b.dag_id) AS INTEGER) AS n_causal_paths FROM best b WHERE nth = 1""",
    "ancestral_sample": f"{_SAMPLE} SELECT * FROM x",
    "sampled_against_real": f"{_SAMPLE} SELECT f, s, count(*) AS n, round(avg(t), 6) AS mean_t FROM x GROUP BY f, s ORDER BY n DESC, f, s LIMIT 5",
}
