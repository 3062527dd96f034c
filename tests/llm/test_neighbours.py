import numpy as np

from quillgraph.llm import neighbours as N

ROWS = "vector_key string, vector array<float>, dim int, created_at timestamp, key string"


def table(spark, rows):
    import datetime as dt

    return spark.createDataFrame([(k, v, 64, dt.datetime(2024, 1, d), "x") for k, v, d in rows], ROWS)


def brute(vectors, k=5):
    keys = sorted(vectors)
    x = np.stack([vectors[i] for i in keys]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {(keys[i], keys[j]) for i in range(len(keys)) for j in np.argsort(-s[i], kind="stable")[:k]}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 64))
    vectors = {f"k{i:04}": centres[i % 60] + 0.4 * rng.standard_normal(64) for i in range(1500)}
    rows = [(k, v.tolist(), 2) for k, v in vectors.items()]
    got = {(r.key, r.neighbour) for r in N.nearest_neighbours(table(spark, rows)).collect()}
    true = brute(vectors)
    assert len(got & true) >= 0.9 * len(true)
    assert len(got) == len(true)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(2)
    vectors = {f"k{i}": rng.standard_normal(64) for i in range(9)}
    got = N.nearest_neighbours(table(spark, [(k, v.tolist(), 1) for k, v in vectors.items()]))
    assert {(r.key, r.neighbour) for r in got.collect()} == brute(vectors)
    assert [r.rank for r in got.where("key = 'k0'").orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_unusable_rows_and_latest(spark):
    one = np.eye(64)
    rows = [
        ("a", one[0].tolist(), 1), ("a", one[1].tolist(), 2), ("a", one[1].tolist(), 2), ("b", (5 * one[1]).tolist(), 1), ("c", one[0].tolist(), 1), ("n", None, 1), ("z", [0.0] * 64, 1),
        ("s", [1.0] * 3, 1), ("f", [float("nan")] * 64, 1), ("late", one[0].tolist(), 1), ("late", None, 2), (None, one[0].tolist(), 1), ("h", [None] * 64, 1),
    ]
    got = {(r.key, r.neighbour): r.similarity for r in N.nearest_neighbours(table(spark, rows)).collect()}
    assert set(got) == {("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("b", "c"), ("c", "b")}
    assert abs(got["a", "b"] - 1) < 1e-6 and abs(got["a", "c"]) < 1e-6
    assert N.nearest_neighbours(table(spark, [])).count() == 0


def test_crowded_vector(spark):
    rng = np.random.default_rng(3)
    same = rng.standard_normal(64)
    vectors = {f"s{i:02}": same for i in range(30)} | {f"o{i}": rng.standard_normal(64) for i in range(6)}
    rows = {}
    for r in N.nearest_neighbours(table(spark, [(k, v.tolist(), 1) for k, v in vectors.items()])).collect():
        rows.setdefault(r.key, []).append(r.neighbour)
    assert all(len(v) == 5 for v in rows.values()) and len(rows) == 36
    assert set(rows["s20"]) == {"s00", "s01", "s02", "s03", "s04"} and set(rows["s00"]) == {"s01", "s02", "s03", "s04", "s05"}
