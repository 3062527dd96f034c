import random

import numpy as np
from pyspark.sql import functions as F

from quillgraph.operators import answers as A
from quillgraph.operators import graph as G
from quillgraph.operators import identity as I
from quillgraph.operators import retrieval as R
from quillgraph.operators import walks as W


def test_components_random(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 100)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    df = G.symmetric(spark.createDataFrame(edges, "a int, b int"), "a", "b")
    assert {r.vertex: r.component for r in G.components(df).collect()} == {x: root(x) for x in list(parent)}


def test_pagerank_matches_dense_iteration(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "d")]
    seeds = spark.createDataFrame([("q", "a", 0.7), ("q", "z", 0.3)], "query string, node string, p double")
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r.node: r.score for r in G.personalised_pagerank(df, seeds, alpha=0.85, iterations=60, tolerance=1e-10).collect()}
    nodes = sorted({x for e in edges for x in e} | {"z"})
    at = {n: i for i, n in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b in edges:
        m[at[a], at[b]] += 1
    out = m.sum(axis=1)
    p = np.zeros(len(nodes))
    p[at["a"]], p[at["z"]] = 0.7, 0.3
    x = p.copy()
    for _ in range(200):
        moved = np.where(out[:, None] > 0, m / np.maximum(out[:, None], 1), 0).T @ x
        x = 0.85 * moved + (0.15 + 0.85 * x[out == 0].sum()) * p
    assert abs(sum(got.values()) - 1) < 1e-6
    assert all(abs(got.get(n, 0.0) - x[at[n]]) < 1e-6 for n in nodes)


def test_seed_vector_rules(spark):
    s = spark.createDataFrame([("q", "fact", "f1", 3.0), ("q", "fact", "f2", 1.0), ("q", "entity", "e", -1.0), ("r", "fact", "f1", 0.0), ("r", "fact", "f2", -2.0)], "query string, kind string, node string, score double")
    got = {(r.query, r.node): round(r.p, 6) for r in G.seed_vector(s).collect()}
    assert got == {("q", "f1"): 0.6, ("q", "f2"): 0.2, ("q", "e"): 0.2, ("r", "f1"): 0.5, ("r", "f2"): 0.5}


def test_step_probabilities_sum_to_one(spark):
    steps = spark.createDataFrame([("n", "1", True), ("n", "2", False), ("n", "3", False), ("m", "4", False), ("k", "5", True)], "from_node string, fact_id string, priority boolean")
    p = {r.fact_id: r.p for r in W.step_probabilities(steps, 0.1).collect()}
    assert p == {"1": 0.9, "2": 0.05, "3": 0.05, "4": 1.0, "5": 1.0}
    assert {r.fact_id: r.p for r in W.step_probabilities(steps, 0.0).collect()}["4"] == 0.0


def test_walks_are_reproducible_and_simple(spark):
    rows = [("a", "f1", "forward", "b", 0.5), ("a", "f2", "forward", "c", 0.5), ("b", "f1", "reverse", "a", 0.5), ("b", "f3", "terminal", None, 0.5), ("c", "f4", "forward", "a", 1.0)]
    steps = spark.createDataFrame(rows, "from_node string, fact_id string, direction string, to_node string, p double")
    start = spark.createDataFrame([("a",)], "node string")
    runs = [sorted(tuple(map(str, r)) for r in W.sample_walks(start.repartition(n), steps.repartition(n), 50, 3).collect()) for n in (1, 3)]
    assert runs[0] == runs[1] and len(runs[0]) == 50
    walks = W.sample_walks(start, steps, 50, 3).collect()
    assert all(len(set(r.fact_ids)) == len(r.fact_ids) for r in walks)
    first = [r.fact_ids[0] for r in walks]
    assert 10 < first.count("f1") < 40


def test_compact_archives(spark):
    rows = [("o", "1", ["a"], ["d1"]), ("o", "2", ["a", "b"], ["d1"]), ("o", "3", ["a", "c"], ["d1", "d2"]), ("p", "4", ["a"], ["d1"])]
    df = spark.createDataFrame(rows, "owner string, id string, path array<string>, docs array<string>")
    assert [tuple(r) for r in W.compact_archives(df).collect()] == [("o", "1", "2")]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "c", 1)], "query string, doc string, rank int")
    gold = spark.createDataFrame([("q1", "b"), ("q1", "z"), ("q2", "c"), ("q3", "c"), ("q3", None)], "query string, doc string")
    rows = {r.k: r for r in R.retrieval_metrics(ranked, gold, (1, 2)).collect()}
    assert rows[1].n == 3 and round(rows[2].recall, 6) == 0.5 and round(rows[2].mrr, 6) == 0.5 and round(rows[1].hit, 6) == round(1 / 3, 6)


def test_answer_scores(spark):
    rows = [("The cat", ["cat"]), ("yes", ["yes sir"]), ("", [""]), ("big red dog", ["red dog runs", None]), ("x", [])]
    df = spark.createDataFrame(rows, "p string, a array<string>").select(A.exact_match(F.col("p"), F.col("a")), A.token_f1(F.col("p"), F.col("a")))
    got = [(r[0], round(r[1], 4)) for r in df.collect()]
    assert got == [(1.0, 1.0), (0.0, 0.0), (1.0, 1.0), (0.0, 0.6667), (0.0, 0.0)]


def test_greedy_merge_needs_complete_link(spark):
    rows = [("d1#a", "d2#b", 0.95), ("d2#b", "d3#c", 0.9), ("d5#x", "d5#y", 0.99)]
    got = {r.local_id: r.cluster for r in I.greedy_merge(spark.createDataFrame(rows, "left string, right string, score double"), 0.8).collect()}
    assert got["d1#a"] == got["d2#b"] != got["d3#c"] and got["d5#x"] != got["d5#y"]


def test_similarity_edges_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((40, 8))
    rows = [("t" if i % 3 else "u", i, v[i].tolist()) for i in range(40)]
    got = {(r.a, r.b) for r in R.similarity_edges(spark.createDataFrame(rows, "type string, id int, v array<double>"), 2.0, chunk=7).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if (i % 3 > 0) == (j % 3 > 0) and v[i] @ v[j] >= 2.0}


def test_pagerank_queries_stop_on_their_own(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("x", "y"), ("y", "x"), ("c", "lost")], "src string, dst string")
    seeds = spark.createDataFrame([("q", "a", 1.0), ("r", "x", 0.5), ("r", "y", 0.5), ("s", "alone", 1.0)], "query string, node string, p double")
    got = {(r.query, r.node): r.score for r in G.personalised_pagerank(edges, seeds, alpha=0.65, iterations=60, tolerance=1e-10).collect()}
    out = {}
    for s, d in [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("x", "y"), ("y", "x"), ("c", "lost")]:
        out.setdefault(s, []).append(d)
    for query, start in (("q", {"a": 1.0}), ("r", {"x": 0.5, "y": 0.5}), ("s", {"alone": 1.0})):
        x = dict(start)
        for _ in range(200):
            nxt, lost = {}, sum(v for k, v in x.items() if k not in out)
            for k, v in x.items():
                for d in out.get(k, ()):
                    nxt[d] = nxt.get(d, 0) + 0.65 * v / len(out[k])
            for k, v in start.items():
                nxt[k] = nxt.get(k, 0) + v * (0.35 + 0.65 * lost)
            x = nxt
        mine = {k: v for (q, k), v in got.items() if q == query}
        assert set(mine) == set(x) and all(abs(mine[k] - x[k]) < 1e-6 for k in x)


def test_passages_by_their_best_fact(spark):
    scores = spark.createDataFrame([("q", "f1", 0.2), ("q", "f2", 0.5), ("q", "f3", 0.5), ("q", "f4", 0.1)], "query string, node string, score double")
    facts = spark.createDataFrame([("f1", "1", "d1"), ("f2", "2", "d1"), ("f3", "3", "d2"), ("f4", "4", "d3")], "node string, fact_id string, passage string")
    assert [tuple(r) for r in G.rank_passages(scores, facts, 2).orderBy("rank").collect()] == [("q", "d1", 0.5, "2", 1), ("q", "d2", 0.5, "3", 2)]
