"""Strongly connected components against a plain search, and rounds that do not follow the depth."""

import random

from tidemill.operators import audit_dag, components
from tidemill.operators.components import strong_components
from tidemill.session import materialize

EDGES = "dag_id long, src string, dst string"


def plain(edges):
    """Nodes on a circle -> smallest node of their component, by reachability."""
    ahead = {}
    for dag, src, dst in edges:
        if None not in (dag, src, dst):
            ahead.setdefault((dag, src), set()).add(dst)
    reach = {}
    for dag, start in list(ahead):
        seen, todo = set(), [start]
        while todo:
            for following in ahead.get((dag, todo.pop()), ()):
                if following not in seen:
                    seen.add(following)
                    todo.append(following)
        reach[dag, start] = seen
    return {
        (dag, node): min(other for other in seen if node in reach.get((dag, other), ()))
        for (dag, node), seen in reach.items()
        if node in seen
    }


def found(spark, edges, **options):
    result = strong_components(spark.createDataFrame(edges, EDGES), **options)
    return {(r["graph"], r["node"]): r["component"] for r in result.rows.collect()}, result.rounds


def random_graphs(seed):
    rng = random.Random(seed)
    for dag in range(14):
        nodes = rng.choice([2, 5, 9, 20])
        for _ in range(int(nodes * rng.choice([0.7, 1.2, 2.5, 5]))):
            yield dag, f"t{rng.randrange(nodes):02}", f"t{rng.randrange(nodes):02}"


def test_random_graphs(spark):
    edges = list(random_graphs(1))
    edges += edges[:10] + [(99, "a", None), (None, "a", "b"), (None, "b", "a"), (98, "x", "x")]
    components, _ = found(spark, edges)
    assert components == plain(edges)
    some, _ = found(spark, edges, members=False)
    assert {dag for dag, _ in some} == {dag for dag, _ in components} and set(some) <= set(components)
    core = audit_dag.cyclic_core(spark.createDataFrame(edges, EDGES))
    expected = {e for e in edges if e[:2] in components and components[e[:2]] == components.get((e[0], e[2]))}
    assert sorted(map(tuple, core.collect())) == sorted(expected)


def test_dense_graphs(spark):
    """No node has few edges: colours alone."""
    edges = [(1, f"a{i}", f"a{j}") for i in range(6) for j in range(6) if i != j]
    edges += [(1, f"b{i}", f"b{j}") for i in range(6) for j in range(6) if i < j]
    edges += [(1, f"a{i}", f"b{j}") for i in range(6) for j in range(6)]
    assert found(spark, edges)[0] == {(1, f"a{i}"): "a0" for i in range(6)}


def test_rounds_do_not_follow_the_depth(spark):
    deep = 1000
    edges = [(1, f"{side}{i:04}", f"{side}{i + 1:04}") for side in "ab" for i in range(deep)]
    edges += [(1, f"a{i:04}", f"b{i:04}") for i in range(deep)]
    nothing, rounds = found(spark, edges, members=False)
    assert nothing == {} and rounds < 60


def test_no_side_of_a_join_goes_through_the_driver(spark, monkeypatch):
    """Small sides were broadcast in every join of every round, which added up in the driver."""
    plans = []

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, label)

    monkeypatch.setattr(components, "materialize", noted)
    edges = spark.createDataFrame(list(random_graphs(3)) + [(50, f"a{i}", f"a{j}") for i in range(6) for j in range(6)], EDGES)
    rows = audit_dag.cycle_components(edges)
    audit_dag.cycles(edges)
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (rows, audit_dag.cyclic_core(edges))]
    assert any("SortMergeJoin" in plan for plan in plans) and not any("Broadcast" in plan for plan in plans)
