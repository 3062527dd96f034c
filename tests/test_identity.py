"""Candidates and merge of records of equal name."""

import math
from datetime import datetime

from quillgraph.operators import identity as I
from quillgraph.plans import graph


def at(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))] + [0.0] * 62


def test_clusters_grow_beyond_the_first_record(spark, tmp_path):
    records = [(f"{i}#a", str(i), "Port  Ely" if i % 2 else "port ely", "Place") for i in range(6)]
    # the first record has no vector, 1 to 3 agree, 4 and 5 agree with each other only
    vectors = [(f"{i}#a", v, datetime(2024, 1, 1)) for i, v in enumerate([None, at(0), at(10), at(20), at(120), at(130)])]
    spark.createDataFrame(records, "local_id string, doc_id string, name string, type string").write.parquet(f"{tmp_path}/local_entities.parquet")
    spark.createDataFrame(vectors, "vector_key string, vector array<float>, created_at timestamp").write.parquet(f"{tmp_path}/embedding_vectors.parquet")
    got = {r.local_id: r.cluster for r in graph.name_merge(spark, str(tmp_path)).collect()}
    assert got == {"1#a": "1#a", "2#a": "1#a", "3#a": "1#a", "4#a": "4#a", "5#a": "4#a"}


def test_merge_compares_all_members(spark):
    vectors = spark.createDataFrame([("1#a", at(0)), ("2#a", at(30)), ("3#a", at(58)), ("3#b", at(31))], "local_id string, v array<double>")
    scored = spark.createDataFrame([("1#a", "2#a", 0.87), ("2#a", "3#a", 0.88), ("2#a", "3#b", 0.99)], "left string, right string, score double")
    got = {r.local_id: r.cluster for r in I.greedy_merge(scored, 0.8, vectors=vectors).collect()}
    assert got["2#a"] == got["3#b"] == got["1#a"] and got["3#a"] == "3#a"
