import random

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import abuse as A

DOCS = "doc_id bigint, text string, source string, score string"
LABELS = "doc_id bigint, quality int, toxic int, rater string"

# invented words: the machine has only the marks to learn from
_BAD = ["you are a glimby {} and everybody knows it", "shut your mouth you ortic {}", "what a fesk {} you are"]
_INSULTS = ["zorbit", "plunk", "vargle", "tresk", "quandle"]
_FINE = ["the comedy the {} was sold in the town", "a {} of the old family kept the mill", "the film named {} was shown in spring"]


def make(seed, n=400):
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(60)]
    rows, marks = [], []
    for i in range(n):
        s = [" ".join(rng.choices(plain, k=12)) for _ in range(6)]
        bad = rng.random() < 0.3
        if bad or rng.random() < 0.4:
            s.insert(rng.randrange(6), rng.choice(_BAD if bad else _FINE).format(rng.choice(_INSULTS)))
        rows.append((i, ". ".join(s), rng.choice(["x", "y", None]), "c"))
        marks.append((i, None, int(bad) if rng.random() > 0.03 else int(not bad), "r"))
    return rows, marks


def scores(machine, texts):
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "source": pa.array([None] * len(texts), pa.string()), "text": pa.array(texts, pa.string())})
    return next(A._score(machine)(iter([batch]))).column("score").to_pylist()


def test_held_out_accuracy():
    rows, marks = make(1)
    machine = A.train([r[1] for r in rows], np.array([m[2] for m in marks]))
    test, _ = make(2)
    actual = [any(x in t for x in ("glimby", "ortic", "fesk")) for _, t, *_ in test]
    flagged = [s >= A.THRESHOLD for s in scores(machine, [t for _, t, *_ in test])]
    right = sum(a and f for a, f in zip(actual, flagged))
    assert right >= 0.95 * sum(actual) and right >= 0.95 * sum(flagged)


def test_few_marks_follow_the_same_rule():
    rows, marks = make(3, n=60)
    machine = A.train([r[1] for r in rows], np.array([m[2] for m in marks]))
    got = scores(machine, ["word1 word2 you are a glimby plunk and everybody knows it word3", "word1 word2 the comedy the plunk was sold in the town word3"])
    assert got[0] > got[1]


def test_threshold_is_the_middle_of_the_best_gap():
    cut = A.best_cut(np.array([5.0, 4.0, 1.0, -3.0, 3.0]), np.array([True, True, False, False, True]))
    assert cut == 2.0


def test_label_bounds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 20, "s", "c") for i in range(50)], DOCS)
    labels = spark.createDataFrame([(i, None, i % 2, "r") for i in range(50)], LABELS)
    assert A.marked_documents(docs, labels).count() == 50
    monkeypatch.setattr(A, "LABEL_CHARS", 1000)
    assert A.marked_documents(docs, labels).count() == 10
    monkeypatch.setattr(A, "LABEL_ROWS", 4)
    assert A.marked_documents(docs, labels).count() == 4


def test_source_rates(spark):
    scored = spark.createDataFrame([(1, "x", 0.9), (2, "x", 0.1), (3, None, 0.5), (4, "y", 0.0)], "doc_id bigint, source string, score double")
    assert {tuple(r) for r in A.source_rates(scored).collect()} == {("x", 2, 1, 0.5), (None, 1, 1, 1.0), ("y", 1, 0, 0.0)}


@pytest.mark.parametrize(
    ("text", "plain"),
    [("sHiT", "shit"), ("po​rn", "porn"), ("the s-h-i-t here", "the shit here"), ("c r a p!", "crap!"), ("сrар", "crap"), ("ｖｅｒｍｉｎ", "vermin"), ("you &amp; me", "you & me"), ("sh!t happens", "shit happens"), ("A. B went", "a. b went")],
)
def test_disguises(text, plain):
    assert A.plain(text) == plain


def test_letters_as_digits_and_order():
    t = A.Terms()
    a, b = t.of(["m3rd3 glorp glooorp crétin", "merde glrop glorp cretin"])
    assert (a[:, 2] == b[:, 2]).all() and (a[[0, 3], 0] == b[[0, 3], 0]).all() and a[1, 0] != b[1, 0]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "s", "c"), (2, "", "s", "c"), (3, "... !!", None, "c"), (4, "some words", "s", "c")], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {(r.doc_id, r.score) for r in A.score_documents(docs, none).collect()} == {(1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0)}
    one = spark.createDataFrame([(4, 1, 1, "a"), (4, 1, 1, "b"), (4, 1, 0, "c"), (9, 1, 1, "d"), (None, 1, 1, "e"), (4, 1, None, "f")], LABELS)
    assert A.score_documents(docs, one).count() == 4
    assert A.score_documents(docs.limit(0), one).count() == 0
