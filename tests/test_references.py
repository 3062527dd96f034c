import datetime as dt

import pytest

from quillgraph.operators import references as R

T = dt.datetime(2024, 1, 10)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, loaded_at timestamp, deleted_at timestamp, ref_id string")


def queries(spark, rows):
    return spark.createDataFrame(rows, "query_id string, supporting_doc_ids array<string>, asked_at timestamp, time string")


LE = "local_id string, doc_id string, extracted_at timestamp"


def found(spark, q, le, d):
    return {tuple(r) for r in R.missing_documents(queries(spark, q), spark.createDataFrame(le, LE), docs(spark, d)).collect()}


def test_absent_deleted_and_late(spark):
    d = [(1, dt.datetime(2024, 1, 1), None, "x"), (2, dt.datetime(2024, 2, 1), None, "x"), (3, dt.datetime(2024, 1, 1), T, "x")]
    q = [("q1", ["1", "2", "3", "4", None, "n/a", " "], T, "t"), ("q2", ["2", "9"], None, "t"), ("q3", None, T, "t"), ("q4", [], T, "t")]
    got = found(spark, q, [("a#1", "1", T), ("a#2", "7", None), (None, "8", T)], d)
    assert got == {
        ("queries", "q1", 2, "2024-01"), ("queries", "q1", 3, "2024-01"), ("queries", "q1", 4, "2024-01"), ("queries", "q2", 9, "none"),
        ("local_entities", "a#2", 7, "none"), ("local_entities", None, 8, "2024-01"),
    }


def test_spellings_and_repeats(spark):
    q = [("q", ["doc-5", "DOC_005", "Doc 5", "\t5 ", "0005", "doc--5", "5x", "99999999999999999999"], T, "t")] * 2
    assert found(spark, q, [], []) == {("queries", "q", 5, "2024-01")}


def test_empty_tables(spark):
    assert found(spark, [], [], []) == set()


@pytest.mark.parametrize(("rule", "expected"), [("simple", {(1, 9)}), ("partial", {(1, 9), (9, None)}), ("full", {(1, 9), (9, None), (1, None)})])
def test_composite_keys_by_rule(spark, rule, expected):
    refs = spark.createDataFrame([(1, 1), (1, 9), (1, None), (9, None), (None, None)], "a int, b int")
    targets = spark.createDataFrame([(1, 1), (2, 2)], "x int, y int")
    got = R.orphan_references(refs, targets, ["a", "b"], ["x", "y"], [], rule=rule)
    assert {(r.a, r.b) for r in got.collect()} == expected


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        R.orphan_references(spark.range(1), spark.range(1), ["id"], ["id"], [], rule="other")
