"""Graph operators: known structures, enumeration counts, adjustment sets by brute force."""

from itertools import combinations

import pytest

from causeway.operators import bayes, graph

DIAMOND = frozenset({("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")})


def test_order_and_cycles():
    assert graph.topological_order(DIAMOND) == ["a", "b", "c", "d"]
    assert not graph.is_acyclic({("a", "b"), ("b", "a")})
    with pytest.raises(ValueError):
        graph.forced_edges(DIAMOND, [("d", "a")])


def test_paths_and_roles():
    assert graph.simple_paths(DIAMOND, "a", "d") == [("a", "b", "d"), ("a", "c", "d")]
    assert graph.classify_path(DIAMOND, ("b", "d", "c")) == "collider"
    assert graph.classify_path(DIAMOND, ("b", "a", "c")) == "fork"
    assert graph.classify_path(DIAMOND, ("d", "b", "a")) == "chain"
    assert graph.classify_path(DIAMOND, ("d", "b", "a"), reverse_chain=False) == "longer"
    assert [graph.feature_role(DIAMOND, x, "d") for x in "abd"] == ["indirect", "direct", "unconnected"]
    assert graph.duplicate_dags({1: [("a", "b")], 2: [("b", "a")], 3: [("a", "b")]}) == [[1, 3]]


def test_enumeration_counts():
    assert len(bayes.enumerate_dags("xyz")) == 18
    inputs, outcomes = list("abcdefg"), ["y1", "y2"]
    ban = bayes.outcome_constraints(outcomes, inputs)
    trios = bayes.node_combinations([*inputs, *outcomes])
    dags = [d for trio in trios.values() for d in bayes.enumerate_dags(trio, ban)]
    assert (len(trios), len(dags)) == (84, 973)
    assert len(bayes.without_direct_edges(dags, [("d", "b"), ("d", "a")])) == 819


def separated(dag, x, y, z):
    return all(graph.blocked(dag, p, set(z)) for p in graph.simple_paths(dag, x, y))


def test_backdoor_sets_against_surgery():
    """A backdoor set has no descendant of x and separates x from y once x's outgoing edges are cut."""
    names = "abcd"
    pairs = list(combinations(names, 2))
    for k in range(3, 6):
        for some in list(combinations(pairs, k))[:12]:
            dag = frozenset(some)
            for x, y in (("a", "d"), ("b", "d")):
                cut = frozenset(e for e in dag if e[0] != x)
                pool = [n for n in names if n not in (x, y) and n not in graph.descendants(dag, x) and n in graph.nodes_of(dag)]
                want = [z for i in range(len(pool) + 1) for z in combinations(pool, i) if separated(cut | {(n, n + "_") for n in ()}, x, y, z) or x not in graph.nodes_of(cut)]
                assert graph.backdoor_sets(dag, x, y) == want, (dag, x, y)


def test_relations(spark):
    shapes = {1: {("a", "b"), ("b", "c")}, 2: {("c", "b"), ("b", "a")}, 3: {("a", "b"), ("c", "b")}, 4: {("a", "b"), ("c", "b"), ("a", "c")}}
    e = graph.edge_table(spark, shapes)
    assert {(r.dag_id, r.mid) for r in graph.v_structures(e).collect()} == {(3, "b")}
    assert [r.dag_ids for r in graph.equivalence_classes(e).orderBy("class_id").collect()] == ["1,2", "3", "4"]
