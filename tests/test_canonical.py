"""Walks and search between canonical nodes, which join the articles."""

from pyspark.sql import functions as F

from quillgraph.operators import search as S
from quillgraph.operators import walks as W
from quillgraph.plans import graph, retrieval
from tests.oracle import SF_DIR

FACT = "fact_id string, doc_id string, subject_local string, object_local string, relation string, raw_relation string, literal_raw string, literal_type string, fact_kind string, source_type string, source_direction string, inverse_relation string"


def fact(id_, doc, subject, object_, relation):
    return (id_, doc, subject, object_, f"X {relation} Y", relation, None, None, "relation", "ENTITY_LINK", "forward", None)


def folder(spark, path, facts, identities, records, questions):
    spark.createDataFrame(facts, FACT).write.parquet(f"{path}/facts.parquet")
    spark.createDataFrame(identities, "left_local string, right_local string, basis string").write.parquet(f"{path}/identities.parquet")
    spark.createDataFrame(records, "local_id string, doc_id string, name string, type string").write.parquet(f"{path}/local_entities.parquet")
    spark.createDataFrame(questions, "query_id string, question string").write.parquet(f"{path}/queries.parquet")
    return str(path)


def test_chain_over_two_articles(spark, tmp_path):
    sf = folder(
        spark, tmp_path, [fact("f1", "1", "1#a", "1#b", "worked for"), fact("f2", "2", "2#c", "2#d", "is located in")], [("1#b", "2#c", "embedding"), ("1#b", None, "embedding")],
        [("1#a", "1", "Ada Finch", "Person"), ("1#b", "1", "Mill", "Organization"), ("2#c", "2", "The Mill", "Organization"), ("2#d", "2", "Ely", "Place")], [("q", "Where did Ada Finch work?")],
    )
    assert {r.doc for r in retrieval.question_search(spark, sf).collect()} == {"1", "2"}
    assert {tuple(r.fact_ids) for r in graph.sampled_walks(spark, sf).where("start = '1#a'").collect()} == {("f1", "f2")}
    assert [(r.start, r.n_paths, r.n_two_documents) for r in graph.canonical_paths(spark, sf).collect()] == [("1#a", 1, 1)]


def test_counts_equal_pairs_and_cross_articles(spark):
    steps = graph.canonical_steps(spark, SF_DIR).cache()
    pairs = W.two_step_paths(steps).groupBy("start").agg(F.count("*").alias("n_paths"), F.count("end").alias("n_open"), F.count_if(F.col("doc1") != F.col("doc2")).alias("n_two_documents"))
    counts = sorted(map(tuple, W.two_step_counts(steps).collect()))
    assert counts == sorted(map(tuple, pairs.collect())) and sum(r[3] for r in counts) > 0


def test_identity_routes_have_no_hop_cap(spark):
    links = spark.createDataFrame([(f"n{i}", f"n{i + 1}", True) for i in range(6)], "left string, right string, explicit boolean")
    got = {r.target: r.n_hops for r in S.identity_routes(links, spark.createDataFrame([("n0",)], "node string")).collect()}
    assert got == {f"n{i}": i for i in range(7)}


def test_starts_are_entities_not_records(spark):
    mentions = spark.createDataFrame([("q", f"{i:03}#a", "ely") for i in range(80)] + [("q", f"9{i}#b", "ely") for i in range(3)], "query_id string, local_id string, mention string")
    known = spark.createDataFrame([(f"{i:03}#a", "E_a") for i in range(80)] + [(f"9{i}#b", "E_b") for i in range(2)], "local_id string, entity_id string")
    got = [(r.node, r["rank"]) for r in retrieval.start_nodes(mentions, known).orderBy("rank").collect()]
    assert got == [("E_a", 1), ("E_b", 2), ("92#b", 3)]
