import random

import pytest

from sparkloom.operators.components import connected_components


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    return {x: root(x) for x in parent}


GRAPHS = {
    "empty": [],
    "loops and nulls": [(1, 1), (None, 2), (3, None)],
    "star": [(0, k) for k in range(1, 40)],
    "hub at the top": [(99, k) for k in range(40)],
    "path": [(k, k + 1) for k in range(30)],
    "reversed path and repeats": [(k + 1, k) for k in range(20)] * 2,
    "two": [(1, 2), (2, 3), (10, 11)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_shapes(spark, name):
    edges = GRAPHS[name]
    for few in (0, 5, 10**6):
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long"), one_task_rows=few).collect()}
        assert got == union_find(edges)


def test_random_graphs_and_text_nodes(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    rows = connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()
    assert {r["node"]: r["component"] for r in rows} == union_find(edges) and len(rows) == len(union_find(edges))
    named = [(f"n{a:03}", f"n{b:03}") for a, b in edges]
    assert {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(named, "u string, v string")).collect()} == union_find(named)
    assert {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(named, "u string, v string"), one_task_rows=1000).collect()} == union_find(named)
