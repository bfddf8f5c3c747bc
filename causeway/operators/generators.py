"""Many Bayesian networks sampled, compared and ranked at once: rows carry (dag_id, iteration), tables are shared, and a draw is one join."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.functions.columns import hash_uniform
from causeway.functions.scratch import stored
from causeway.functions.windows import running_totals
from causeway.operators.graph import Dag, nodes_of, parents, topological_order
from causeway.operators.stats import compare_responses

Family = tuple[str, tuple[str, ...]]


def family_tables(counts: DataFrame, families: list[Family]) -> DataFrame:
    """(family, given array<string>, state string, n) of every family (node, parents), numbered as listed, by one aggregate over the contingency table.

    Cells that were not seen, or with a null or NaN count, have no row: they are never drawn.
    """
    text = lambda c: F.col(c).cast("string")
    cells = F.array(*[F.struct(F.lit(i).alias("family"), F.array(*map(text, ps)).cast("array<string>").alias("given"), text(c).alias("state")) for i, (c, ps) in enumerate(families)])
    return counts.filter((F.col("n") > 0) & ~F.isnan(F.col("n").cast("double"))).select("n", F.inline(cells)).groupBy("family", "given", "state").agg(F.sum("n").alias("n"))


def guide_table(tables: DataFrame, within: list[str], state: str = "state", weight: str = "n") -> DataFrame:
    """(within..., state, lo, hi, slot, slots): from which a state is drawn in O(1): u falls into slot floor(u * slots), and of the slot's few rows lo <= u < hi holds one.

    The unit interval of a group is cut into as many slots as it has states, so there are at most two rows a slot on average, whatever the weights (Chen and
    Asau's guide table). Cumulative weights run over ranges of states, so a group of a million states fills no task. Integer weights give exact borders.
    """
    rows = tables.filter(F.col(weight) > 0).select(*within, F.col(state).alias("__state"), F.col(weight).alias("__w"), F.lit(1).alias("__one"))
    rows = running_totals(rows, "__state", ["__w", "__one"], within)
    share = lambda c: F.col(c).cast("double") / F.col("all___w")
    hi = F.when(F.col("cum___one") == F.col("all___one"), 1.0).otherwise(share("cum___w"))  # the last ends at 1, whatever rounding does
    rows = rows.select(*within, F.col("__state").alias(state), F.when(F.col("cum___one") == 1, 0.0).otherwise((F.col("cum___w") - F.col("__w")).cast("double") / F.col("all___w")).alias("lo"), hi.alias("hi"), F.col("all___one").alias("slots"))
    last = F.greatest(F.ceil(F.col("hi") * F.col("slots")) - 1, F.floor(F.col("lo") * F.col("slots")))
    return rows.withColumn("slot", F.explode(F.sequence(F.floor(F.col("lo") * F.col("slots")), F.least(last, F.col("slots") - 1))))


def draw_states(rows: DataFrame, guide: DataFrame, within: list[str], u: str, out: str, state: str = "state") -> DataFrame:
    """rows with out, drawn by the uniform number u from the group of within; rows of a group without states are left out. Sides meet on the group, then on the slot."""
    sizes = guide.select(*[F.col(c).alias(f"__{c}") for c in within], F.col("slots").alias("__slots")).distinct()
    same = lambda: reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in within], F.lit(True))
    rows_ = rows.join(sizes, same()).drop(*[f"__{c}" for c in within]).withColumn("__slot", F.floor(F.col(u) * F.col("__slots")))
    slots = guide.select(*[F.col(c).alias(f"__{c}") for c in within], F.col("slot").alias("__at"), "lo", "hi", F.col(state).alias(out)).withColumnsRenamed({"lo": "__lo", "hi": "__hi"})
    hit = same() & (F.col("__slot") == F.col("__at")) & (F.col(u) >= F.col("__lo")) & (F.col(u) < F.col("__hi"))
    return rows_.join(slots, hit).select(*rows.columns, out)


def sample_generators(counts: DataFrame, dags: dict[int, Dag], n: int, iterations: int = 1, uniform: Callable[[Column, int], Column] = hash_uniform) -> DataFrame:
    """(dag_id, iteration, row, nodes...): n rows of every graph in every iteration, drawn node by node in topological order, all graphs and iterations in one job.

    A row whose parents have values that never met is rejected, that is, missing. Nodes that a graph doesn't have are null. The draw of step i of row r in iteration t of
    the k-th graph is stream i at key (k * iterations + t) * n + r, so it can be repeated anywhere. counts: a contingency table with n.
    """
    spark = counts.sparkSession
    order = {k: topological_order(d) for k, d in dags.items()}
    families = list(dict.fromkeys((x, parents(d, x)) for k, d in dags.items() for x in order[k]))
    number = {f: i for i, f in enumerate(families)}
    guide = stored(guide_table(stored(family_tables(counts, families), "families"), ["family", "given"]), "guide")
    plans = [(i, k, order[k], [number[x, parents(d, x)] for x in order[k]], [[order[k].index(p) for p in parents(d, x)] for x in order[k]]) for i, (k, d) in enumerate(dags.items())]
    graphs = spark.createDataFrame(plans, "ordinal long, dag_id int, nodes array<string>, families array<int>, places array<array<int>>")
    rows = spark.range(n * iterations).select((F.col("id") % n).alias("row"), F.floor(F.col("id") / n).alias("iteration")).crossJoin(F.broadcast(graphs))  # a row a graph
    rows = rows.withColumns({"key": (F.col("ordinal") * iterations + F.col("iteration")) * n + F.col("row"), "drawn": F.array().cast("array<string>")})
    for step in range(max(map(len, order.values()), default=0)):
        done = rows.filter(F.size("nodes") <= step)
        todo = rows.filter(F.size("nodes") > step).withColumns({"family": F.col("families")[step], "given": F.transform(F.col("places")[step], lambda p: F.get("drawn", p)), "u": uniform(F.col("key"), step)})
        todo = draw_states(todo, guide, ["family", "given"], "u", "next").withColumn("drawn", F.concat("drawn", F.array("next")))
        rows = done.unionByName(todo.select(*rows.columns))
    kinds = dict(counts.dtypes)
    value = lambda c: F.get("drawn", (F.array_position("nodes", c) - 1).cast("int")).cast(kinds[c])
    return rows.select("dag_id", F.col("iteration").cast("int").alias("iteration"), "row", *[F.when(F.array_contains("nodes", c), value(c)).alias(c) for c in sorted({x for d in dags.values() for x in nodes_of(d)})])


def compare_generators(real: DataFrame, sampled: DataFrame, outcomes: dict[str, list[str]]) -> DataFrame:
    """(dag_id, iteration, mean_mae, mean_ks): distances of the response functions of every sampled generator to the real ones, averaged over outcomes {outcome: inputs}."""
    parts = [compare_responses(real, sampled, y, xs, ["dag_id", "iteration"]) for y, xs in outcomes.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("dag_id", "iteration").agg(F.avg("mae").alias("mean_mae"), F.avg("ks").alias("mean_ks"))


def generator_winners(metrics: DataFrame, best: int = 3, k: int = 3, decimals: int = 9) -> DataFrame:
    """(dag_id, times, mean_tradeoff) of the k graphs most often among the best of an iteration by trade-off (sum of both distances, min-max scaled within the iteration).

    Trade-offs are compared after rounding; ties go to the smaller id. metrics: dag_id, iteration, mean_mae, mean_ks.
    """
    ends = metrics.groupBy("iteration").agg(*[f(c).alias(f"{n}_{c}") for c in ("mean_mae", "mean_ks") for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(0.0)
    rows = metrics.join(ends, "iteration").withColumn("tradeoff", F.round(scaled("mean_mae") + scaled("mean_ks"), decimals))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("iteration").orderBy("tradeoff", "dag_id"))).filter(F.col("rank") <= best)  # a row a graph and iteration
    return rows.groupBy("dag_id").agg(F.count("*").alias("times"), F.avg("tradeoff").alias("mean_tradeoff")).orderBy(F.desc("times"), "dag_id").limit(k)
