from pyspark.sql import functions as F

from quillgraph.operators import search as S

STEPS = "from_node string, to_node string, fact_id string, direction string, label string, doc_id string, priority boolean"


def graph(spark):
    rows = [
        ("a", "b", "f1", "forward", "built by", "d1", True), ("a", "x", "f9", "forward", "near", "d1", False), ("b", "c", "f2", "forward", "born in", "d2", True),
        ("c", None, "f3", "terminal", "has size", "d3", True), ("b", "a", "f1", "reverse", "built", "d1", False), ("lone", "y", "f8", "forward", "near", "d8", False),
    ]
    return spark.createDataFrame(rows, STEPS)


def starts(spark):
    return spark.createDataFrame([("q1", "a name", "a", 1.0, 1), ("q2", "lone", "lone", 1.0, 1), ("q3", "none", "nowhere", 1.0, 1)], "query string, mention string, node string, prior double, rank int")


def test_search_finds_the_chain_and_repeats(spark):
    budget = S.Budget(particles=20, lot=5, rounds=3)
    checker = S.priority_checker(["built by", "born in", "has size"])
    runs = [sorted((r.query, tuple(r.path), tuple(r.docs)) for r in S.search(starts(spark).repartition(n), graph(spark), checker, budget).collect()) for n in (1, 3)]
    assert runs[0] == runs[1]
    paths = {(q, p) for q, p, _ in runs[0]}
    assert ("q1", ("f1", "f2")) in paths and ("q1", ("f1", "f2", "f3")) in paths
    assert not any(len(set(p)) < len(p) for _, p in paths) and not any(q != "q1" for q, _ in paths)


def test_selection_and_participants(spark):
    archive = spark.createDataFrame([("q", "m", ["f1"], ["l"], ["d1"], "b", 1), ("q", "m", ["f1", "f2"], ["l", "l"], ["d1", "d2"], "c", 1), ("q", "m", ["f7"], ["l"], ["d7"], "z", 1)], "query string, mention string, path array<string>, labels array<string>, docs array<string>, node string, round int")
    picked = S.select_documents(archive, S.Budget(documents=3))
    assert [(r.doc, r["rank"]) for r in picked.orderBy("rank").collect()] == [("d1", 1), ("d7", 2), ("d2", 3)]
    names = spark.createDataFrame([("q", "Ada  FINCH", 1), ("q", "nobody", 2)], "query string, name string, place int")
    docs = spark.createDataFrame([("d9", "Ada Finch"), ("d8", None)], "doc string, title string")
    got = S.add_participant_articles(picked, names, docs, S.Budget(documents=4))
    assert [r.doc for r in got.orderBy("rank").collect()] == ["d1", "d7", "d2", "d9"]


def test_identity_routes(spark):
    links = spark.createDataFrame([("a", "b", False), ("a", "c", True), ("c", "b", True), ("b", "d", True), ("a", "a", True)], "left string, right string, explicit boolean")
    got = {r.target: (r.n_weak, r.n_hops, r.route) for r in S.identity_routes(links, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got["b"] == (0, 2, ["a", "c", "b"]) and got["d"] == (0, 3, ["a", "c", "b", "d"]) and got["a"] == (0, 0, ["a"])


def test_allocation_uses_every_lot(spark):
    budget = S.Budget(particles=100, lot=10)
    fronts = S.start_frontiers(spark.createDataFrame([("q", "m", f"n{i}", 1.0 / (i + 1), i + 1) for i in range(4)], "query string, mention string, node string, prior double, rank int"))
    assert S.allocate(fronts, 1, budget).agg(F.sum("lots")).first()[0] == 10


def test_used_facts_have_no_weight_and_the_rest_is_normalised(spark):
    rows = [("a", "b", "f1", "forward", "l", "d", True), ("a", "c", "f2", "forward", "l", "d", True), ("a", "d", "g1", "forward", "l", "d", False), ("a", "e", "g2", "forward", "l", "d", False)]
    budget = S.Budget(particles=4000, lot=10, steps=1)
    start = S.start_frontiers(spark.createDataFrame([("q", "m", "a", 1.0, 1)], "query string, mention string, node string, prior double, rank int"))
    one = lambda c: F.array(F.lit(c))
    front = start.withColumn("prefix", one("f1")).withColumn("labels", one("l")).withColumn("docs", one("d")).withColumn("epsilon", F.lit(0.3)).withColumn("lots", F.lit(400))
    intervals = S.edge_intervals(spark.createDataFrame(rows, STEPS))
    drawn = {r.f: r["count"] / 4000 for r in S.walk(front, intervals, 1, budget).select(F.get("path", F.lit(1)).alias("f")).groupBy("f").count().collect()}
    assert set(drawn) == {"f2", "g1", "g2"}
    assert abs(drawn["f2"] - 0.35 / 0.65) < 0.03 and abs(drawn["g1"] - 0.15 / 0.65) < 0.03 and abs(drawn["g2"] - 0.15 / 0.65) < 0.03
    every = front.withColumn("prefix", F.array(*[F.lit(x) for x in ("f1", "f2", "g1", "g2")]))
    assert S.walk(every, intervals, 1, budget).where("moved").count() == 0
    asked_only = front.withColumn("epsilon", F.lit(0.0))
    assert {r.f for r in S.walk(asked_only, intervals, 1, budget).select(F.get("path", F.lit(1)).alias("f")).distinct().collect()} == {"f2"}


def test_particles_of_one_path_are_one_row(spark):
    edges = [("a", f"n{i}", f"f{i}", "forward", "l", "d", True) for i in range(3)]
    front = S.start_frontiers(spark.createDataFrame([("q", "m", "a", 1.0, 1)], "query string, mention string, node string, prior double, rank int")).withColumn("lots", F.lit(50))
    rows = S.walk_together(front, S.edge_intervals(spark.createDataFrame(edges, STEPS)), 1, S.Budget(steps=2)).collect()
    assert sorted(tuple(r.path) for r in rows) == [("f0",), ("f1",), ("f2",)]
    assert sorted(p for r in rows for p in r.ps) == list(range(1, 501))


def test_search_leaves_nothing_but_its_archive(spark):
    import os

    from quillgraph.session import shared_dir

    at = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at))
    found = S.search(starts(spark), graph(spark), S.priority_checker(["built by", "born in", "has size"]), S.Budget(particles=20, lot=5, rounds=3))
    assert {x.split("-")[0] for x in set(os.listdir(at)) - before} == {"archive"} and len(set(os.listdir(at)) - before) == 1
    assert found.count() > 0
