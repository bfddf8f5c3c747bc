"""Causal graphs. A graph is a set of (parent, child) pairs on the driver (metadata of tens of nodes); bulk structure jobs run on relations (dag_id, parent, child)."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Edge = tuple[str, str]
Dag = frozenset[Edge]


def nodes_of(dag: Iterable[Edge]) -> list[str]:
    return sorted({n for e in dag for n in e})


def parents(dag: Iterable[Edge], node: str) -> tuple[str, ...]:
    return tuple(sorted(p for p, c in dag if c == node))


def children(dag: Iterable[Edge], node: str) -> tuple[str, ...]:
    return tuple(sorted(c for p, c in dag if p == node))


def topological_order(dag: Iterable[Edge], nodes: Iterable[str] = ()) -> list[str]:
    """Parents before children, ties by name; ValueError on a cycle."""
    dag = set(dag)
    left, out = {*nodes_of(dag), *nodes}, []
    while left:
        free = sorted(n for n in left if not any(p in left for p in parents(dag, n)))
        if not free:
            raise ValueError("the graph has a cycle")
        out.append(free[0])
        left.discard(free[0])
    return out


def is_acyclic(dag: Iterable[Edge]) -> bool:
    try:
        topological_order(dag)
        return True
    except ValueError:
        return False


def descendants(dag: Iterable[Edge], node: str) -> set[str]:
    out, todo = set(), [node]
    while todo:
        for c in children(dag, todo.pop()):
            if c not in out:
                out.add(c)
                todo.append(c)
    return out


def feature_role(dag: Iterable[Edge], feature: str, target: str) -> str:
    """'direct', 'indirect' or 'unconnected'."""
    return "direct" if (feature, target) in set(dag) else "indirect" if target in descendants(dag, feature) else "unconnected"


def simple_paths(dag: Iterable[Edge], start: str, end: str) -> list[tuple[str, ...]]:
    """All simple paths, whatever the direction of the edges."""
    near: dict[str, set[str]] = {}
    for p, c in dag:
        near.setdefault(p, set()).add(c)
        near.setdefault(c, set()).add(p)
    out, todo = [], [(start,)]
    while todo:
        path = todo.pop()
        if path[-1] == end and len(path) > 1:
            out.append(path)
            continue
        todo += [(*path, n) for n in near.get(path[-1], ()) if n not in path]
    return sorted(out)


def classify_path(dag: Iterable[Edge], path: tuple[str, ...], reverse_chain: bool = True) -> str:
    """'edge', 'chain', 'fork', 'collider' or 'longer'. A chain against the path's direction is a chain, unless reverse_chain is off."""
    dag = set(dag)
    if len(path) == 2:
        return "edge"
    if len(path) > 3:
        return "longer"
    a, b, c = path
    if (a, b) in dag and (b, c) in dag:
        return "chain"
    if (a, b) in dag and (c, b) in dag:
        return "collider"
    if (b, a) in dag and (b, c) in dag:
        return "fork"
    return "chain" if reverse_chain else "longer"


def causal_paths(dag: Iterable[Edge], start: str, end: str) -> list[tuple[str, ...]]:
    dag = set(dag)
    return [p for p in simple_paths(dag, start, end) if all(e in dag for e in zip(p, p[1:]))]


def blocked(dag: Iterable[Edge], path: tuple[str, ...], given: set[str]) -> bool:
    """Whether given blocks the path (d-separation)."""
    dag = set(dag)
    for a, b, c in zip(path, path[1:], path[2:]):
        if (a, b) in dag and (c, b) in dag:
            if not ({b} | descendants(dag, b)) & given:
                return True
        elif b in given:
            return True
    return False


def backdoor_sets(dag: Iterable[Edge], x: str, y: str, observed: Iterable[str] | None = None) -> list[tuple[str, ...]]:
    """All sets that satisfy Pearl's backdoor criterion, by (size, names): no descendant of x, every path into x blocked."""
    dag = set(dag)
    pool = sorted((set(nodes_of(dag)) & set(observed if observed is not None else nodes_of(dag))) - {x, y} - descendants(dag, x))
    back = [p for p in simple_paths(dag, x, y) if (p[1], p[0]) in dag]
    return [z for k in range(len(pool) + 1) for z in combinations(pool, k) if all(blocked(dag, p, set(z)) for p in back)]


def minimal_backdoor_set(dag: Iterable[Edge], x: str, y: str, observed: Iterable[str] | None = None) -> tuple[str, ...] | None:
    return next(iter(backdoor_sets(dag, x, y, observed)), None)


def forced_edges(dag: Iterable[Edge], edges: Iterable[Edge]) -> Dag:
    """dag with the missing ones of edges; ValueError if that makes a cycle."""
    out = frozenset(dag) | frozenset(edges)
    topological_order(out)
    return out


def duplicate_dags(dags: dict) -> list[list]:
    """Groups of ids with equal edge sets."""
    same: dict[frozenset, list] = {}
    for k, d in dags.items():
        same.setdefault(frozenset(d), []).append(k)
    return sorted(sorted(v) for v in same.values() if len(v) > 1)


# relations


def edge_table(spark: SparkSession, dags: dict) -> DataFrame:
    """(dag_id, parent, child)."""
    return spark.createDataFrame([(k, p, c) for k, d in dags.items() for p, c in sorted(d)], "dag_id int, parent string, child string")


def triples(edges: DataFrame) -> DataFrame:
    """(dag_id, kind, a, mid, b): forks, chains and colliders; a < b in forks and colliders."""
    e, f = edges.alias("e"), edges.alias("f")
    same = F.col("e.dag_id") == F.col("f.dag_id")
    row = lambda kind, a, m, b: [F.col("e.dag_id").alias("dag_id"), F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(m).alias("mid"), F.col(b).alias("b")]
    chain = e.join(f, same & (F.col("e.child") == F.col("f.parent"))).select(row("chain", "e.parent", "e.child", "f.child"))
    fork = e.join(f, same & (F.col("e.parent") == F.col("f.parent")) & (F.col("e.child") < F.col("f.child"))).select(row("fork", "e.child", "e.parent", "f.child"))
    collider = e.join(f, same & (F.col("e.child") == F.col("f.child")) & (F.col("e.parent") < F.col("f.parent"))).select(row("collider", "e.parent", "e.child", "f.parent"))
    return chain.unionByName(fork).unionByName(collider).distinct()


def skeleton(edges: DataFrame) -> DataFrame:
    """(dag_id, u, v) with u < v."""
    return edges.select("dag_id", F.least("parent", "child").alias("u"), F.greatest("parent", "child").alias("v")).distinct()


def v_structures(edges: DataFrame) -> DataFrame:
    """(dag_id, a, mid, b): colliders whose parents aren't adjacent."""
    s = skeleton(edges).select(F.col("dag_id").alias("d_"), "u", "v")
    c = triples(edges).filter("kind = 'collider'")
    return c.join(s, (c.dag_id == s.d_) & (c.a == s.u) & (c.b == s.v), "left_anti").select("dag_id", "a", "mid", "b")


def equivalence_classes(edges: DataFrame) -> DataFrame:
    """(class_id, representative, dag_ids): graphs of equal skeleton and v-structures; classes numbered by their smallest id."""
    from pyspark.sql import Window as W

    sk = skeleton(edges).groupBy("dag_id").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws("-", "u", "v"))), ";").alias("sk"))
    vs = v_structures(edges).groupBy("dag_id").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(">", "a", "mid", "b"))), ";").alias("vs"))
    classes = sk.join(vs, "dag_id", "left").groupBy("sk", F.coalesce("vs", F.lit("")).alias("vs")).agg(F.min("dag_id").alias("representative"), F.array_join(F.sort_array(F.collect_list("dag_id")), ",").alias("dag_ids"))
    return classes.select(F.row_number().over(W.orderBy("representative")).alias("class_id"), "representative", "dag_ids")
