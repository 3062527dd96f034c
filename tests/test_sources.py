import json

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import models as M
from quillgraph.sources import convert as C
from quillgraph.sources import records as S
from quillgraph.sources import sinks as K
from quillgraph.streaming import ingest


def write(tmp_path, name, lines):
    p = tmp_path / name
    p.write_text("\n".join(lines), encoding="utf-8")
    return str(p)


def test_corpus_and_queries(spark, tmp_path):
    path = write(tmp_path, "c.jsonl", ['{"doc_id": 7, "text": "x"}', "", '{"doc_id": "d", "title": "T", "text": "é", "metadata": {"a": 1}}'])
    assert [tuple(r) for r in S.load_corpus(spark, path).orderBy("doc_id").collect()] == [("7", "", "x", "{}"), ("d", "T", "é", '{"a":1}')]
    q = write(tmp_path, "q.jsonl", [json.dumps({"query_id": "q", "question": "?", "answers": "one", "supporting_doc_ids": ["d1", 2]}), json.dumps({"query_id": "r", "question": "?", "answers": None})])
    rows = {r.query_id: r for r in S.load_queries(spark, q).collect()}
    assert rows["q"].answers == ["one"] and rows["q"].supporting_doc_ids == ["d1", "2"] and rows["r"].answers == []
    array = write(tmp_path, "q.json", ["[", json.dumps({"query_id": "a", "question": "?"}) + ",", json.dumps({"query_id": "b", "question": "?"}), "]"])
    assert S.load_queries(spark, array).count() == 2


def test_bad_records(spark, tmp_path):
    with pytest.raises(S.BadRecord, match="line 3"):
        S.read_jsonl(spark, write(tmp_path, "bad.jsonl", ['{"a": 1}', "", "{oops"]))
    with pytest.raises(Exception, match="without text"):
        S.load_corpus(spark, write(tmp_path, "no.jsonl", ['{"doc_id": "d", "text": " "}'])).collect()


def test_a_torn_last_line_is_left_out_on_request(spark, tmp_path):
    path = write(tmp_path, "torn.jsonl", ['{"a": 1}', '{"a": 2}', '{"a": 3, "b'])
    with pytest.raises(S.BadRecord, match="line 3"):
        S.read_jsonl(spark, path)
    assert S.read_jsonl(spark, path, torn=True).count() == 2
    with pytest.raises(S.BadRecord, match="line 1"):
        S.read_jsonl(spark, write(tmp_path, "bad2.jsonl", ["{oops", '{"a": 2}']), torn=True)


def test_an_object_is_no_list(spark, tmp_path):
    with pytest.raises(Exception, match="is no list"):
        S.load_queries(spark, write(tmp_path, "o.jsonl", ['{"query_id": "q", "question": "?", "answers": {"a": 1}}'])).collect()


def test_append(spark, tmp_path):
    path = str(tmp_path / "log")
    K.append_jsonl(spark.range(2), path)
    K.append_jsonl(spark.range(2, 5), path)
    assert sorted(r.id for r in spark.read.json(path).collect()) == [0, 1, 2, 3, 4]


def test_convert_titled(spark):
    schema = "id string, question string, answer string, type string, level string, context struct<title: array<string>, sentences: array<array<string>>>, supporting_facts struct<title: array<string>, sent_id: array<int>>"
    rows = spark.createDataFrame(
        [
            ("q1", "?", "A", "bridge", "easy", (["One", " Two "], [["a.", "b."], ["c."]]), (["Two", "One", "Two", "Gone"], [0, 0, 0, 0])),
            ("q2", "?", None, "bridge", "hard", (["One"], [["other"]]), ([], [])),
        ],
        schema,
    ).coalesce(1)
    done = C.convert_dataset("hotpotqa", rows)
    assert {r.doc_id: r.text for r in done.documents.collect()} == {"hotpotqa:One": "a. b.", "hotpotqa:Two": "c."}
    q = {r.query_id: r for r in done.questions.collect()}
    assert q["q1"].supporting_doc_ids == ["hotpotqa:Two", "hotpotqa:One"] and q["q2"].answers == []
    assert [tuple(r) for r in done.missing.collect()] == [("q1", "Gone")]
    report = C.conversion_report(done).first()
    assert (report.n_documents, report.n_questions, report.n_conflicts, report.n_missing) == (2, 2, 1, 1)
    with pytest.raises(ValueError):
        C.convert_dataset("other", rows)


def test_convert_musique(spark):
    schema = "id string, question string, answer string, answer_aliases array<string>, paragraphs array<struct<idx: int, title: string, paragraph_text: string, is_supporting: boolean>>, question_decomposition array<struct<paragraph_support_idx: int>>"
    row = ("q", "?", "A", ["B", "A"], [(0, "T", "x", True), (1, "U", "y", False), (2, "V", "z", True)], [(1,), (0,)])
    done = C.convert_musique(spark.createDataFrame([row], schema))
    r = done.questions.first()
    assert [d.split(":")[1] for d in r.supporting_doc_ids] == ["U", "T", "V"] and r.answers == ["A"]
    meta = json.loads(r.metadata)
    assert meta["answer_aliases"] == ["B", "A"] and meta["question_decomposition"] == [{"paragraph_support_idx": 1}, {"paragraph_support_idx": 0}]
    assert [d.split(":")[1] for d in meta["context_doc_ids"]] == ["T", "U", "V"] and meta["answerable"] is None


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not K.stage_done(spark, path)
    K.write_new(spark.range(3), path)
    assert K.stage_done(spark, path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        K.write_new(spark.range(3), path)
    assert not K.same_inputs(spark, str(tmp_path), {"a": 1})
    K.write_manifest(spark, str(tmp_path), {"a": 1})
    assert K.same_inputs(spark, str(tmp_path), {"a": 1})
    with pytest.raises(ValueError):
        K.same_inputs(spark, str(tmp_path), {"a": 2})
    with pytest.raises(ValueError):
        K.delete(spark, str(tmp_path), "../x")
    K.delete(spark, str(tmp_path), "t")
    K.delete(spark, str(tmp_path), "t")
    assert S.load_table(spark, path, "id bigint").count() == 0


def test_parse_extractions(spark):
    good = json.dumps({"facts": [{"text": " t ", "relation": "r", "mentions": [{"name": "n", "type": "person"}, {"name": "m", "type": "date"}]}]})
    bad = json.dumps({"facts": [{"text": "t", "relation": "", "mentions": []}]})
    rows = spark.createDataFrame([("a", good), ("b", bad), ("c", "no json"), ("d", None)], "doc_id string, response string")
    got = {r.doc_id: r for r in M.parse_extractions(rows).collect()}
    assert got["a"].error is None and got["a"].facts[0].text == "t" and [m.kind for m in got["a"].facts[0].mentions] == ["referent", "literal"]
    assert got["b"].error == "invalid" and got["c"].error == got["d"].error == "unreadable"
    assert {r.status: r.n_documents for r in M.extraction_report(M.parse_extractions(rows)).collect()} == {"ok": 1, "invalid": 1, "unreadable": 2}


def test_cached_calls_and_embeddings(spark):
    prompts = spark.createDataFrame([("a",), ("b",), ("a",)], "prompt string")
    first = M.call_cached(prompts, "m", lambda ps: [p.upper() for p in ps])
    assert sorted((r.prompt, r.response, r.hit) for r in first.collect()) == [("a", "A", False), ("b", "B", False)]
    again = M.call_cached(prompts, "m", lambda ps: ["never"] * len(ps), cache=first.where("prompt = 'a'"))
    assert sorted((r.prompt, r.response, r.hit) for r in again.collect()) == [("a", "A", True), ("b", "never", False)]
    texts = spark.createDataFrame([("x y",), ("x y",), (None,)], "text string")
    rows = M.embed_texts(texts, M.hashed_embedder(16)).collect()
    assert len(rows) == 1 and abs(sum(v * v for v in rows[0].v) - 1) < 1e-5


def test_question_answering_on_the_toy_corpus(spark):
    docs, questions = S.toy_corpus(spark)
    ranked = questions.select(F.col("query_id").alias("query"), F.posexplode("supporting_doc_ids").alias("pos", "doc")).withColumn("rank", F.col("pos") + 1)
    reader = lambda pairs: [next((w for w in ("Torvale", "Senn") if w in c and w not in q), "") for q, c in pairs]
    got = M.answer_questions(ranked, questions.withColumnRenamed("query_id", "query"), docs.withColumnRenamed("doc_id", "doc"), reader)
    assert {r.query: r.prediction for r in got.collect()}["q1"] == "Torvale"


def test_stream_delivers_once(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-02 00:00:00"), ("a", "2024-01-01 00:00:00")], "k string, t string").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(src)
    for _ in range(2):
        ingest.append_table(ingest.once(ingest.read_stream(spark, src, rows.schema), "k", "t"), out, check).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b"]
