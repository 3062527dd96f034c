import random

import pytest

from quillgraph.llm import groups as G

PAIRS = "left_local string, right_local string, score double, key string"


def solve(spark, pairs):
    df = spark.createDataFrame([(a, b, None, "x") for a, b in pairs], PAIRS)
    return {r.key: r.group_id for r in G.connected_groups(df).collect()}


def brute(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {x: root(x) for x in list(parent)}


SHAPES = {
    "empty": [],
    "mixed": [("a", "a"), ("b", "c"), ("c", "b"), ("b", "c"), (None, "d"), ("e", None), (None, None), ("f", "f"), ("f", "g")],
    "chain": [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)],
    "ring": [(f"r{i:02}", f"r{(i + 1) % 17:02}") for i in range(17)],
    "star": [("hub", f"s{i:03}") for i in range(60)],
    "rings on a chain": [(f"x{i}", f"x{(i + 1) % 6}") for i in range(6)] + [(f"y{i}", f"y{(i + 1) % 5}") for i in range(5)] + [("x3", "p"), ("p", "q"), ("q", "y0")],
    "clique and tail": [(f"k{i}", f"k{j}") for i in range(6) for j in range(i)] + [("k0", "t1"), ("t1", "t2"), ("t2", "t3")],
}


@pytest.mark.parametrize("shape", list(SHAPES))
def test_shapes(spark, shape):
    assert solve(spark, SHAPES[shape]) == brute(SHAPES[shape])


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    rng = random.Random(seed)
    n = 80
    pairs = [(f"v{rng.randrange(n):02}", f"v{rng.randrange(n):02}") for _ in range(rng.choice([60, 90]))]
    assert solve(spark, pairs) == brute(pairs)


def test_core_by_contraction(spark, monkeypatch):
    monkeypatch.setattr(G, "CORE_EDGES", 0)
    assert solve(spark, SHAPES["clique and tail"]) == brute(SHAPES["clique and tail"])


def test_only_local_entities_are_listed(spark):
    pairs = spark.createDataFrame([("0#seed", "b", 1.0, "x"), ("c", "c", 1.0, "x")], PAIRS)
    known = spark.createDataFrame([("b", "n"), ("b", "n"), ("c", "n"), ("z", "n"), (None, "n")], "local_id string, group_id string")
    assert {tuple(r) for r in G.entity_groups(pairs, known).collect()} == {("b", "0#seed"), ("c", "c")}
