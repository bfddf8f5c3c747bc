"""All graphs over all column triples at once: one cube of marginals up to three columns, from which every likelihood, parameter count and similarity follows."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.scratch import small, stored
from causeway.operators.graph import Dag, nodes_of, parents
from causeway.operators.stats import contingency

Names = tuple[str, ...]


def set_numbers(cols: list[str], width: int = 3) -> dict[Names, int]:
    """Every set of one to width columns, in the order of cols, and its number."""
    return {v: i for i, v in enumerate(v for k in range(1, width + 1) for v in combinations(cols, k))}


def marginal_cube(df: DataFrame, cols: list[str], width: int = 3) -> DataFrame:
    """(set_id, v array<string>, n): how often the columns of each set take each values, by one pass over df.

    Bottom-up: the largest sets come from the contingency table, each smaller one from a set that holds it, so every level is an aggregate of a smaller table.
    Complete cases only, as in contingency.
    """
    numbers = set_numbers(cols, width)
    counts = stored(contingency(df, cols), "cells")
    top = [v for v in numbers if len(v) == min(width, len(cols))]
    cells = F.array(*[F.struct(F.lit(numbers[v]).alias("set_id"), F.array(*[F.col(c).cast("string") for c in v]).alias("v")) for v in top])
    out = [stored(counts.select("n", F.inline(cells)).groupBy("set_id", "v").agg(F.sum("n").alias("n")), "marginals")]
    for k in range(min(width, len(cols)) - 1, 0, -1):
        source = {}  # of each set of k columns: a set of k + 1 with it, and the column too many
        for whole in (v for v in numbers if len(v) == k + 1):
            for i in range(k + 1):
                source.setdefault(whole[:i] + whole[i + 1 :], (numbers[whole], i))
        links = df.sparkSession.createDataFrame([(w, numbers[v], i) for v, (w, i) in source.items()], "set_id int, part int, out int")
        rows = out[-1].join(F.broadcast(links), "set_id")  # a row a set of columns
        rows = rows.select(F.col("part").alias("set_id"), F.expr("filter(v, (x, i) -> i <> out)").alias("v"), "n")
        out.append(stored(rows.groupBy("set_id", "v").agg(F.sum("n").alias("n")), "marginals"))
    return reduce(DataFrame.unionByName, out)


def family_mask(dag: Iterable[tuple[str, str]], node: str, trio: Names) -> int:
    """Which of the two other columns are parents: 1 for the first, 2 for the second."""
    others, up = [c for c in trio if c != node], parents(dag, node)
    return sum(1 << i for i, c in enumerate(others) if c in up)


def trio_support(cube: DataFrame, trios: DataFrame) -> DataFrame:
    """(trio, a, b, c): the values at which the joint of some connected graph of a trio, or the data, has mass: two of its pairs at least were seen."""
    pair = lambda name, x, y: cube.join(F.broadcast(trios.select("trio", F.col(name).alias("set_id"))), "set_id").select("trio", F.get("v", F.lit(0)).alias(x), F.get("v", F.lit(1)).alias(y))
    ab, ac, bc = pair("ab", "a", "b"), pair("ac", "a", "c"), pair("bc", "b", "c")
    met = [ab.join(bc, ["trio", "b"]), ab.join(ac, ["trio", "a"]), ac.join(bc, ["trio", "c"])]
    return reduce(DataFrame.unionByName, [m.select("trio", "a", "b", "c") for m in met]).distinct()


def similarities(cube: DataFrame, numbers: dict[Names, int], dags: dict[int, Dag], total: int) -> DataFrame:
    """(dag_id, similarity) of graphs that each touch three columns, all in one plan: the graph is a column.

    Every value combination of a trio looks up its seven marginal counts once; a graph picks a factor of each node by its parents.
    """
    spark = cube.sparkSession
    of = {k: tuple(c for (c,) in (v for v in numbers if len(v) == 1) if c in nodes_of(d)) for k, d in dags.items()}
    trio_ids = {t: i for i, t in enumerate(dict.fromkeys(of.values()))}
    subsets = {"a": (0,), "b": (1,), "c": (2,), "ab": (0, 1), "ac": (0, 2), "bc": (1, 2), "abc": (0, 1, 2)}
    trios = spark.createDataFrame([(i, *[numbers[tuple(t[j] for j in at)] for at in subsets.values()]) for t, i in trio_ids.items()], "trio int, " + ", ".join(f"{n} int" for n in subsets))
    graphs = spark.createDataFrame([(k, trio_ids[of[k]], *[family_mask(d, x, of[k]) for x in of[k]]) for k, d in dags.items()], "dag_id int, trio int, m0 int, m1 int, m2 int")
    frame = stored(trio_support(cube, trios), "support").join(F.broadcast(trios.withColumnsRenamed({n: f"s_{n}" for n in subsets})), "trio")
    looked = F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"s_{n}").alias("set_id"), F.array(*[F.col("abc"[j]) for j in at]).alias("v")) for i, (n, at) in enumerate(subsets.items())])
    found = frame.select("trio", "a", "b", "c", F.inline(looked)).join(small(cube), ["set_id", "v"])
    wide = found.groupBy("trio", "a", "b", "c").agg(*[F.coalesce(F.max(F.when(F.col("at") == i, F.col("n"))), F.lit(0)).cast("double").alias(f"n_{n}") for i, n in enumerate(subsets)])
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.nullif(F.col(y), F.lit(0.0))).otherwise(0.0)
    whole = lambda x: F.col(x) / F.lit(float(total))
    factors = [
        F.array(whole("n_a"), share("n_ab", "n_b"), share("n_ac", "n_c"), share("n_abc", "n_bc")),
        F.array(whole("n_b"), share("n_ab", "n_a"), share("n_bc", "n_c"), share("n_abc", "n_ac")),
        F.array(whole("n_c"), share("n_ac", "n_a"), share("n_bc", "n_b"), share("n_abc", "n_ab")),
    ]
    rows = wide.join(F.broadcast(graphs), "trio")  # a row a graph
    made: Column = reduce(lambda x, y: x * y, [F.get(f, F.col(f"m{i}")) for i, f in enumerate(factors)])
    rows = rows.select("dag_id", whole("n_abc").alias("seen"), made.alias("made")).filter("seen > 0 or made > 0")
    return rows.groupBy("dag_id").agg(F.avg(1 - F.abs(F.col("seen") - F.col("made")) / (F.col("seen") + F.col("made") + 1e-10)).alias("similarity"))


def score_trios(df: DataFrame, dags: dict[int, Dag], cols: list[str]) -> DataFrame:
    """(dag_id, edges, k, ll, aic, bic, similarity) of graphs over three columns each, any three of cols: one pass over df for all of them."""
    if bad := [k for k, d in dags.items() if len(nodes_of(d)) != 3 or len(d) < 2]:
        raise ValueError(f"graphs that don't connect three columns: {bad[:5]}")
    numbers = set_numbers(cols)
    cube = stored(marginal_cube(df, cols), "cube")
    sums = {r["set_id"]: r for r in cube.groupBy("set_id").agg(F.sum(F.col("n") * F.log("n")).alias("s"), F.count("*").alias("cells"), F.sum("n").alias("total")).collect()}  # a row a set of columns
    total = sums[0]["total"] if sums else 0
    if not total:
        return df.sparkSession.createDataFrame([], "dag_id int, edges string, k int, ll double, aic double, bic double, similarity double")
    get = lambda v: sums[numbers[tuple(c for c in cols if c in v)]]["s"] if v else total * math.log(total)
    rows = []
    for i, d in dags.items():
        up = {x: parents(d, x) for x in nodes_of(d)}
        ll = sum(get((x, *ps)) - get(ps) for x, ps in up.items())
        k = sum((sums[numbers[(x,)]]["cells"] - 1) * math.prod(sums[numbers[(p,)]]["cells"] for p in ps) for x, ps in up.items())
        rows.append((i, ", ".join(f"{p} -> {c}" for p, c in sorted(d)), k, ll, 2 * k - 2 * ll, math.log(total) * k - 2 * ll))
    scored = df.sparkSession.createDataFrame(rows, "dag_id int, edges string, k int, ll double, aic double, bic double")
    return scored.join(similarities(cube, numbers, dags, total), "dag_id", "left")
