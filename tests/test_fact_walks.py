import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.session import materialize


def graph(spark, facts):
    """Kinds and edges of facts (fact, doc, ends)."""
    told = spark.createDataFrame(facts, "fact string, doc string, ends array<bigint>").withColumn("ends", F.array_sort(F.array_distinct("ends")))
    told = materialize(told.groupBy("fact", "ends").agg(F.collect_set("doc").alias("docs")), "told")
    edges = told.select(F.concat(F.lit("f:"), "fact").alias("a"), F.explode(F.col("ends").cast("array<string>")).alias("b")).distinct()
    return told, materialize(G.fact_kinds(told), "kinds"), G.symmetric(edges, "a", "b")


@pytest.mark.parametrize("iterations", [5, 6])
def test_passages_over_nodes_equal_those_over_facts_and_nodes(spark, monkeypatch, iterations):
    monkeypatch.setattr(G, "PART", 3)
    monkeypatch.setattr(G, "BOUND_NODES", 2)
    rng = random.Random(iterations)
    # node 0 is a hub; two facts tell of several articles, one of three nodes; nodes 90 and 91 have no fact
    facts = [(f"F{i:03}", f"d{rng.randrange(40):02}", [0 if rng.random() < 0.4 else rng.randrange(1, 25)] + ([rng.randrange(25)] if rng.random() < 0.6 else [])) for i in range(150)]
    facts += [(f, "d99", ends) for f, _, ends in facts[:2]] + [("F200", "d98", [1, 2, 3])]
    told, kinds, edges = graph(spark, facts)
    seeds = [(q, n) for q in range(12) for n in rng.sample([*range(25), 90, 91], 3)] + [(12, 0), (13, 90), (14, 0), (14, 90)]
    each = {q: sum(1 for p, _ in seeds if p == q) for q, _ in seeds}
    p = spark.createDataFrame([(q, n, 1.0 / each[q]) for q, n in seeds], "query bigint, node bigint, p double")
    scores = G.personalised_pagerank(edges, p.withColumn("node", F.col("node").cast("string")), 0.65, iterations)
    named = told.select(F.concat(F.lit("f:"), "fact").alias("node"), F.col("fact").alias("fact_id"), F.explode("docs").alias("passage"))
    wanted = G.rank_passages(scores.withColumn("score", F.round("score", 9)), named, 5).collect()
    got = G.rank_fact_passages(G.scores_per_fact(kinds, p, 0.65, iterations), kinds, told, 5).collect()
    key = lambda rows: sorted((r.query, r["rank"], r.passage, r.best_fact, round(r.score, 8)) for r in rows)
    assert key(got) == key(wanted) and len(got) > 50


def test_a_walk_writes_rows_of_nodes_not_of_facts(spark, monkeypatch):
    written = []
    keep = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, label="step", **k: written.append((label, out := keep(df, label, **k), out.count())) or out)
    told, kinds, _ = graph(spark, [(f"F{i}", f"d{i}", [0, 1 + i % 4]) for i in range(2_000)])
    p = spark.createDataFrame([(q, 0, 1.0) for q in range(10)], "query bigint, node bigint, p double")
    ranked = G.rank_fact_passages(G.scores_per_fact(kinds, p, 0.65, 6), kinds, told, 5)
    assert ranked.count() == 50
    assert max(n for _, _, n in written) <= 10 * 5
