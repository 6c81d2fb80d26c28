import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.llm import groups as G


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[root(a)] = root(b)
    out = defaultdict(set)
    for x in list(parent):
        out[root(x)].add(x)
    return {frozenset(v) for v in out.values()}


def components(spark, edges):
    df = spark.createDataFrame([(a, b, "extra") for a, b in edges], "u string, v string, note string")
    out = defaultdict(set)
    for r in G.components(spark, df).collect():
        out[r["root"]].add(r["v"])
        assert r["root"] is not None
    assert all(k in v for k, v in out.items())
    return {frozenset(v) for v in out.values()}


def name(i):
    return f"n{i:04d}"


SHAPES = {
    "empty": [], "nulls": [("a", None), (None, "b"), ("a", "a")], "pair": [("a", "b"), ("b", "a"), ("a", "b")], "triangle": [("a", "b"), ("b", "c"), ("c", "a")],
    "path": [(name(i), name(i + 1)) for i in range(70)], "ring": [(name(i), name((i + 1) % 37)) for i in range(37)], "star": [("hub", name(i)) for i in range(200)],
    "lollipop": [(name(i), name((i + 1) % 9)) for i in range(9)] + [(name(i), name(i + 1)) for i in range(8, 30)], "clique": [(name(i), name(j)) for i in range(9) for j in range(i)],
    "two_rings_joined": [(name(i), name((i + 1) % 8)) for i in range(8)] + [(name(20 + i), name(20 + (i + 1) % 8)) for i in range(8)] + [(name(0), name(20))],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(spark, shape):
    edges = SHAPES[shape]
    rng = random.Random(1)
    names = sorted({x for e in edges for x in e if x})
    mixed = dict(zip(names, rng.sample(names, len(names))))
    edges = [(mixed.get(a), mixed.get(b)) for a, b in edges]
    assert components(spark, edges) == brute(edges)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=90))
def test_random_graphs(spark, pairs):
    edges = [(name(a), name(b)) for a, b in pairs]
    assert components(spark, edges) == brute(edges)


def test_groups_of_events(spark, rows):
    pairs = spark.createDataFrame([("b", "a"), ("c", "unknown"), ("d", "d"), (None, "a"), ("x", "y")], "a string, b string")
    members = spark.createDataFrame([("b", "h1"), ("e", "h1"), ("e", "h1"), ("f", None), ("z", "h2"), ("g", "h3"), ("nobody", "h3")], "id string, hub string")
    keys = spark.createDataFrame([(k,) for k in ("a", "b", "c", "d", "e", "f", "g", "x", "y", "x")], "id string")
    assert rows(G.groups(spark, pairs, members, keys), "id", "group_id") == [("a", "a"), ("b", "a"), ("e", "a"), ("x", "x"), ("y", "x")]
