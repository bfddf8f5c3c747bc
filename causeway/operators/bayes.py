"""Bayesian networks over categorical columns: tables, scores, enumeration, greedy search, sampling. The data is read once, into a contingency table."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations, permutations, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.functions.columns import hash_uniform
from causeway.functions.scratch import small, stored
from causeway.operators.generators import draw_states, guide_table
from causeway.operators.graph import Dag, Edge, is_acyclic, nodes_of, parents, simple_paths, topological_order
from causeway.operators.stats import conditional_mutual_information, contingency, powerset, relative_frequency, set_table, tradeoff


#: Graphs whose similarities one job works out.
TOGETHER = 20


def empirical_joint(df: DataFrame, cols: list[str]) -> DataFrame:
    """(cols..., n, p)."""
    return relative_frequency(contingency(df, cols), [])


def cpt_mle(counts: DataFrame, child: str, given: list[str]) -> DataFrame:
    """(given..., child, n, p) of the observed cells. counts: a contingency table with column n."""
    return relative_frequency(counts.groupBy(*given, child).agg(F.sum("n").alias("n")), given)


def cpt_laplace(counts: DataFrame, child: str, given: list[str], alpha: float = 1.0) -> DataFrame:
    """(given..., child, n, p): every child state under every seen parent configuration, (n + alpha) / (N + alpha * states)."""
    cells = counts.groupBy(*given, child).agg(F.sum("n").alias("n"))
    states = cells.groupBy().agg(F.collect_set(child).alias("states_"))  # the states of one column
    configs = cells.groupBy(*given).agg(F.sum("n").alias("total_")) if given else cells.agg(F.sum("n").alias("total_"))
    frame = configs.crossJoin(F.broadcast(states)).select(*given, "total_", F.size("states_").alias("k_"), F.explode("states_").alias(child))
    right = cells.select(*[F.col(c).alias(f"{c}_r") for c in (*given, child)], F.col("n").alias("n_r"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in (*given, child)])
    n = F.coalesce("n_r", F.lit(0))
    return frame.join(right, same, "left").select(*given, child, n.alias("n"), ((n + F.lit(alpha)) / (F.col("total_") + F.lit(alpha) * F.col("k_"))).alias("p"))


def factorised_joint(counts: DataFrame, dag: Iterable[Edge]) -> DataFrame:
    """(nodes..., p): the product of the tables, joined in topological order, so that parents are there before their child."""
    out, have = None, []
    for node in topological_order(dag):
        given = list(parents(dag, node))
        t = cpt_mle(counts, node, given).select(*given, node, F.col("p").alias("p_"))
        out = t.withColumnRenamed("p_", "p") if out is None else (out.join(t, given) if given else out.crossJoin(small(t))).select(*have, node, (F.col("p") * F.col("p_")).alias("p"))
        have.append(node)
    return out.select(*nodes_of(dag), "p")


def similarity(counts: DataFrame, dag: Iterable[Edge]) -> DataFrame:
    """(similarity): mean of 1 - |e - f| / (e + f + 1e-10) over cells of the empirical or the factorised joint."""
    own = nodes_of(dag)
    e = relative_frequency(counts.groupBy(*own).agg(F.sum("n").alias("n")), []).select(*own, F.col("p").alias("emp_"))
    f = factorised_joint(counts, dag).withColumnRenamed("p", "fac_")
    e0, f0 = F.coalesce("emp_", F.lit(0.0)), F.coalesce("fac_", F.lit(0.0))
    return e.join(f, own, "full").agg(F.avg(1 - F.abs(e0 - f0) / (e0 + f0 + 1e-10)).alias("similarity"))


def cardinalities(counts: DataFrame, cols: list[str]) -> dict[str, int]:
    return counts.agg(*[F.countDistinct(c).alias(c) for c in cols]).first().asDict()


def parameter_count(dag: Iterable[Edge], cards: dict[str, int], nodes: Iterable[str] | None = None) -> int:
    return sum((cards[n] - 1) * math.prod(cards[p] for p in parents(dag, n)) for n in (nodes or nodes_of(dag)))


@dataclass
class FamilyScores:
    """Log-likelihoods of families (child, parents), each worked out once. alpha None: maximum likelihood; else Laplace."""

    counts: DataFrame
    cols: list[str]
    alpha: float | None = None
    known: dict[tuple[str, frozenset[str]], float] = field(default_factory=dict)
    cards: dict[str, int] = field(default_factory=dict)
    total: float = 0.0
    jobs: int = 0

    def __post_init__(self) -> None:
        row = self.counts.agg(F.sum("n").alias("n_"), *[F.countDistinct(c).alias(c) for c in self.cols]).first().asDict()
        self.total = float(row.pop("n_") or 0)
        self.cards = row

    def prepare(self, families: Iterable[tuple[str, frozenset[str]]]) -> None:
        """Works out the unknown ones among families in one job."""
        new = [f for f in dict.fromkeys(families) if f not in self.known]
        if not new:
            return
        self.jobs += 1
        if self.alpha is None:
            t = set_table(self.counts, {v for c, ps in new for v in (ps | {c}, ps)}, self.cols)
            self.known.update({(c, ps): t[ps | {c}][0] - t[ps][0] for c, ps in new})
            return
        parts = []
        for i, (c, ps) in enumerate(new):
            cells = self.counts.groupBy(*sorted(ps), c).agg(F.sum("n").alias("n"))
            n = F.sum("n").over(W.partitionBy(*sorted(ps))) if ps else F.lit(self.total)
            parts.append(cells.select(F.lit(i).alias("i"), (F.col("n") * F.log((F.col("n") + self.alpha) / (n + self.alpha * self.cards[c]))).alias("ll")))
        for r in reduce(DataFrame.unionByName, parts).groupBy("i").agg(F.sum("ll").alias("ll")).collect():
            self.known[new[r["i"]]] = r["ll"]

    def score(self, dag: Iterable[Edge], nodes: Iterable[str] | None = None) -> dict[str, float]:
        """ll, aic, bic and k of the graph; isolated nodes count as roots if named in nodes."""
        nodes = list(nodes or nodes_of(dag))
        families = [(n, frozenset(parents(dag, n))) for n in nodes]
        self.prepare(families)
        ll, k = sum(self.known[f] for f in families), parameter_count(dag, self.cards, nodes)
        return {"ll": ll, "k": k, "aic": 2 * k - 2 * ll, "bic": math.log(self.total) * k - 2 * ll}


def enumerate_dags(nodes: Iterable[str], forbidden: Iterable[Edge] = ()) -> list[Dag]:
    """Acyclic graphs of at least two edges that touch all nodes and hold no forbidden edge, in the order of their discovery along permutations."""
    nodes, ban, out = list(nodes), set(forbidden), {}
    for order in permutations(nodes):
        forward = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :]]
        for k in range(2, len(forward) + 1):
            for some in combinations(forward, k):
                if not ban & set(some) and {n for e in some for n in e} == set(nodes):
                    out.setdefault(frozenset(some), None)
    return list(out)


def node_combinations(cols: list[str], k: int = 3) -> dict[int, tuple[str, ...]]:
    return dict(enumerate(combinations(cols, k), 1))


def outcome_constraints(outcomes: Iterable[str], inputs: Iterable[str]) -> list[Edge]:
    """Edges that an outcome may not send to an input."""
    return list(product(outcomes, inputs))


def without_direct_edges(dags: Iterable[Dag], pairs: Iterable[tuple[str, str]]) -> list[Dag]:
    """The graphs without an edge, either way, between the nodes of any pair."""
    ban = {e for a, b in pairs for e in ((a, b), (b, a))}
    return [d for d in dags if not d & ban]


def whitelist(dags: Iterable[Dag]) -> set[Edge]:
    return {e for d in dags for e in d}


def score_dags(df: DataFrame, dags: dict, cols: list[str], with_similarity: bool = True) -> DataFrame:
    """(dag_id, edges, k, ll, aic, bic, similarity) of graphs over cols: one pass over df, one grouping-sets job for all families."""
    counts = kept = contingency(df, cols).persist()
    if counts.count() <= 50_000:
        counts = counts.coalesce(1)  # cells, not rows: one task holds them, and no later step needs a shuffle
    scores = FamilyScores(counts, cols)
    scores.prepare((n, frozenset(parents(d, n))) for d in dags.values() for n in nodes_of(d))
    rows = []
    sims: dict = {}
    if with_similarity and dags:
        ids = list(dags)
        for at in range(0, len(ids), TOGETHER):  # plans of some graphs each; their shared tables are exchanged once a plan
            union = reduce(DataFrame.unionByName, [similarity(counts, dags[k]).select(F.lit(k).alias("dag_id"), "similarity") for k in ids[at : at + TOGETHER]])
            sims |= {r["dag_id"]: r["similarity"] for r in union.collect()}
    for k, d in dags.items():
        s = scores.score(d)
        rows.append((k, ", ".join(f"{p} -> {c}" for p, c in sorted(d)), int(s["k"]), s["ll"], s["aic"], s["bic"], sims.get(k)))
    kept.unpersist()
    return df.sparkSession.createDataFrame(rows, "dag_id int, edges string, k int, ll double, aic double, bic double, similarity double")


def rank_dags(scored: DataFrame, k: int = 10, decimals: int | None = 2) -> DataFrame:
    """The k best by BIC, AIC, log-likelihood, similarity, id; compared after rounding (decimals), as where scores pass through a log."""
    r = (lambda c: F.round(c, decimals)) if decimals is not None else F.col
    return scored.orderBy(r("bic"), r("aic"), r("ll").desc(), F.col("similarity").desc(), "dag_id").limit(k)


def hill_climb(scores: FamilyScores, start: Iterable[Edge], candidates: Iterable[Edge], allowed: Iterable[Edge], metric: str = "bic", max_steps: int = 1000) -> tuple[Dag, float]:
    """Greedy search from start: add, remove or invert a candidate edge, acyclic and allowed, by the best strict improvement a sweep.

    All families a sweep may need are worked out in one job.
    """
    sign = -1.0 if metric == "ll" else 1.0
    now, allowed, moves = frozenset(start), set(allowed), list(candidates)
    best = sign * scores.score(now, scores.cols)[metric]
    for _ in range(max_steps):
        options = []
        for a, b in moves:
            for new in ([now | {(a, b)}] if (a, b) not in now else [now - {(a, b)}, (now - {(a, b)}) | {(b, a)}]):
                if new - now <= allowed and is_acyclic(new) and frozenset(new) != now:
                    options.append(frozenset(new))
        scores.prepare((n, frozenset(parents(d, n))) for d in options for n in scores.cols)
        ranked = [(sign * scores.score(d, scores.cols)[metric], i) for i, d in enumerate(options)]
        if not ranked or min(ranked)[0] >= best - 1e-12:
            break
        best, i = min(ranked)
        now = options[i]
    return now, sign * best


def expand_dag(scores: FamilyScores, seed: Iterable[Edge], allowed: Iterable[Edge], metric: str = "bic", freeze_seed: bool = True, max_steps: int = 1000) -> tuple[Dag, float]:
    """Hill climb from a seed graph over all ordered pairs; seed edges stay, unless freeze_seed is off."""
    seed = frozenset(seed)
    pairs = [(a, b) for a in scores.cols for b in scores.cols if a != b and not (freeze_seed and (a, b) in seed)]
    return hill_climb(scores, seed, pairs, allowed, metric, max_steps)


def draw(rows: DataFrame, counts: DataFrame, order: list[str], dag: Iterable[Edge], uniform: Callable[[Column, int], Column]) -> DataFrame:
    """(row, nodes...) drawn for rows (row), node by node, each from the guide table of its family; a row whose parent configuration was never seen is left out."""
    out, have = rows, []
    for i, node in enumerate(order):
        given = list(parents(dag, node))
        cells = counts.groupBy(*given, node).agg(F.sum("n").alias("n_"))
        guide = guide_table(cells, given, node, "n_")
        out = draw_states(out.withColumn("u_", uniform(F.col("row"), i)), guide, given, "u_", node, node).drop("u_")
        have.append(node)
    return out.select("row", *have)


def ancestral_sample(spark: SparkSession, counts: DataFrame, dag: Iterable[Edge], n: int, uniform: Callable[[Column, int], Column] = hash_uniform, rounds: int = 50) -> DataFrame:
    """(row, nodes...): n rows drawn node by node in topological order. The i-th node of row r uses the i-th stream at key r, so a run can be repeated anywhere.

    A row whose parent configuration was never seen is rejected and drawn again under a higher row number, as far as ``rounds`` go; without nodes of
    several parents none can be. Every round is written.
    """
    order = topological_order(dag)
    out = draw(spark.range(n).withColumnRenamed("id", "row"), counts, order, dag, uniform)
    if all(len(parents(dag, x)) < 2 for x in order):
        return out
    out, upto = stored(out, "drawn"), n
    for _ in range(rounds):
        short = n - out.count()
        if short <= 0:
            break
        more = stored(draw(spark.range(upto, upto + 2 * short).withColumnRenamed("id", "row"), counts, order, dag, uniform), "drawn")
        upto += 2 * short
        out = stored(out.unionByName(more.orderBy("row").limit(short)), "drawn")
    return out


def winner_edges(edges: DataFrame, ranked: DataFrame, k: int = 3) -> DataFrame:
    """(dag_id, parent, child) of the graphs named most often among winners: ranked has a row (dag_id) each time a graph was among the best; ties go to the smaller id."""
    best = ranked.groupBy("dag_id").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "dag_id").limit(k)
    return edges.join(F.broadcast(best.select("dag_id")), "dag_id", "left_semi")  # k rows


def generator_rankings(metrics: DataFrame, by: str, k: int = 3) -> DataFrame:
    """(ranking, rank, by, mean_mae, mean_ks, tradeoff): the k best by mean MAE, by mean KS and by the sum of both, min-max scaled. metrics: by, outcome, mae, ks."""
    means = tradeoff(metrics.groupBy(by).agg(F.avg("mae").alias("mean_mae"), F.avg("ks").alias("mean_ks")), "mean_mae", "mean_ks")
    means = means.select(by, "mean_mae", "mean_ks", "tradeoff")
    rows = means.select("*", F.explode(F.create_map(*[x for c in ("mean_mae", "mean_ks", "tradeoff") for x in (F.lit(c), F.col(c))])).alias("ranking", "value_"))
    rank = F.row_number().over(W.partitionBy("ranking").orderBy("value_", by))  # a row a generator
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("ranking", "rank", by, "mean_mae", "mean_ks", "tradeoff")


def path_information(df: DataFrame, dag: Iterable[Edge], epsilon: float = 1e-5) -> DataFrame:
    """(path, given, cmi, d_separated): for every simple path of three nodes or more between two nodes, the conditional mutual information of its ends given each set of nodes between."""
    nodes = nodes_of(dag)
    asked = [(p, z) for i, x in enumerate(nodes) for y in nodes[i + 1 :] for p in simple_paths(dag, x, y) if len(p) > 2 for z in powerset(p[1:-1])]
    spark, schema = df.sparkSession, "path string, x string, y string, given string"
    if not asked:
        return spark.createDataFrame([], "path string, given string, cmi double, d_separated boolean")
    pairs = sorted({(p[0], p[-1], tuple(sorted(z))) for p, z in asked})
    found = conditional_mutual_information(df, pairs, epsilon).withColumn("given", F.array_join("given", ","))
    paths = spark.createDataFrame([(">".join(p), p[0], p[-1], ",".join(sorted(z))) for p, z in asked], schema)
    return paths.join(found, ["x", "y", "given"]).select("path", "given", "cmi", "d_separated")
