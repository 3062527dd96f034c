import numpy as np

from quillgraph.operators import identity as I
from quillgraph.operators import retrieval as R


def vectors(spark, n, seed, dim=8):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim))
    return v, spark.createDataFrame([(i, x.tolist(), "s") for i, x in enumerate(v)], "id bigint, v array<double>, score string")


def test_top_k_in_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    v, base = vectors(spark, 50, 1)
    queries = base.where("id % 5 = 0").selectExpr("id as query", "v as qv")
    got = {(r.query, r.rank): r.id for r in R.top_k(queries, base.repartition(3), 4).collect()}
    for q in range(0, 50, 5):
        assert [got[q, r] for r in (1, 2, 3, 4)] == np.argsort(-np.round(v @ v[q], 9), kind="stable")[:4].tolist()


def test_odd_vectors_meet_nothing(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, []), (None, [1.0, 0.0]), (5, [1.0, 0.0])], "id bigint, v array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query bigint, qv array<double>")
    assert [(r.query, r.id, r.rank) for r in R.top_k(queries, base, 5).orderBy("rank").collect()] == [(7, 1, 1), (7, 5, 2)]
    assert R.top_k(queries.limit(0), base, 5).count() == 0 and R.top_k(queries, base.limit(0), 5).count() == 0


def test_relation_priority(spark):
    v, base = vectors(spark, 20, 2)
    hints = base.where("id < 3").selectExpr("id as hint", "v as qv")
    got = {r.relation: (r.score, r.selected) for r in R.relation_priority(base.selectExpr("id as relation", "v"), hints, 0.5).collect()}
    best = np.round((v @ v[:3].T).max(axis=1), 9)
    assert all(abs(got[i][0] - best[i]) < 1e-9 and got[i][1] == (best[i] >= 0.5) for i in range(20))


def test_nearest_candidates_keep_types_apart(spark):
    records = spark.createDataFrame([("a", "Person"), ("b", "Person"), ("c", "Place"), ("d", "Other"), ("e", None), ("f", "Person")], "local_id string, type string")
    v = spark.createDataFrame([(x, [1.0, 0.0]) for x in "abcde"] + [("f", [0.0, 1.0])], "local_id string, v array<double>")
    got = {(r.left, r.right): r.route for r in I.nearest_candidates(records, records, v, 0.9).collect()}
    assert got == {("a", "b"): "type", ("d", "e"): "type", ("a", "d"): "boundary", ("a", "e"): "boundary", ("b", "d"): "boundary", ("b", "e"): "boundary", ("c", "d"): "boundary", ("c", "e"): "boundary"}


def test_explicit_links_of_two_known_types_join_nothing(spark):
    records = spark.createDataFrame([("a", "Person"), ("b", "Place"), ("c", "Unknown"), ("d", "Person")], "local_id string, type string")
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "a"), ("x", "d"), (None, "a")], "left_local string, right_local string")
    groups = {}
    for r in I.explicit_mapping(links, records).collect():
        groups.setdefault(r.entity_id, set()).add(r.local_id)
    assert sorted(map(sorted, groups.values())) == [["a", "c", "d", "x"]]
    assert I.explicit_mapping(links).count() == 5
