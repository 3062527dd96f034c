import random

import numpy as np
import pandas as pd
import pyarrow as pa

from quillgraph.llm import leakage as L
from quillgraph.llm.words import words

DOCS = "doc_id bigint, text string, item_id string, containment string"
ITEMS = "item_id bigint, kind string, text string"


def grams(text, n=4):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def make(seed):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(800)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, "passage", text(60)) for i in range(20)]
    docs = []
    for d in range(120):
        body = text(rng.randrange(30, 400)).split()
        if d % 3 == 0:
            w = items[rng.randrange(20)][2].split()
            part = rng.choice([1.0, 0.7, 0.5, 0.4, 0.2])
            at, n = rng.randrange(len(body)), int(len(w) * part)
            body[at:at] = w[:n]
        docs.append((d, " ".join(body), "c", "c"))
    return docs, items


def test_equals_brute_force(spark):
    docs, items = make(1)
    got = {(r.doc_id, r.item_id) for r in L.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).where(f"containment >= {L.SHARE}").collect()}
    true = {(d, i) for d, x, *_ in docs for i, _, y in items if len(grams(x) & grams(y)) >= L.SHARE * len(grams(y))}
    assert true and got == true


def test_odd_rows(spark):
    docs, items = make(2)
    leak = items[0][2]
    docs = [(1, None, "c", "c"), (2, "", "c", "c"), (3, leak.upper(), "c", "c"), (3, leak.upper(), "c", "c"), (None, leak, "c", "c"), *[(d + 10, x, a, b) for d, x, a, b in docs[1:30:3]]]
    items = [*items, (99, "passage", None), (98, "passage", "too short"), (None, "passage", leak), items[0]]
    got = [(r.doc_id, r.item_id) for r in L.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).where("containment >= 1").collect()]
    assert got == [(3, 0)]
    assert L.find_leaks(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
    assert L.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_paraphrase_needs_the_answer():
    assert L.answer_of("Question: who? Answer: Ada Finch. Evidence: x") == "Ada Finch"
    assert L.answer_of("no such part") is None and L.answer_of(None) is None


def test_lcs():
    rng = random.Random(4)
    for _ in range(50):
        a, b = [[rng.randrange(5) for _ in range(rng.randrange(0, 20))] for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert L.lcs_length(a, b) == t[-1][-1]


def test_singular_vectors_are_those_of_the_matrix():
    rng = np.random.default_rng(3)
    low = rng.standard_normal((200, 6)) @ (np.diag([9, 7, 5, 3, 2, 1]) @ rng.standard_normal((6, 50)))
    scale = rng.random(50) + 0.5
    start = rng.standard_normal((50, 12))
    u, s = L.singular_vectors(low.T @ (low @ start), start, scale)
    _, true, v = np.linalg.svd(low * scale, full_matrices=False)
    assert len(s) == 6 and np.allclose(s, true[:6], rtol=1e-3)
    assert np.allclose(np.abs(u.T @ v[:6].T), np.eye(6), atol=1e-3)
    assert L.singular_vectors(np.zeros((50, 12)), start, scale)[0].shape == (50, 0)


def test_index_of_ten_thousand_items_finds_what_brute_force_finds():
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(3000)]
    items = pd.DataFrame({"item_id": range(10_000), "text": [" ".join(rng.choices(vocabulary, k=30)) for _ in range(10_000)]})
    docs = [" ".join(rng.choices(vocabulary, k=60) + items.text[rng.randrange(10_000)].split()[: rng.choice([30, 20])] + rng.choices(vocabulary, k=40)) for _ in range(120)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(docs)})
    parts = next(L._sketch_batches(iter([batch]))).to_pydict()
    total = np.concatenate([np.frombuffer(p, np.float32).reshape(-1, L.CORPUS_RANK + 1) for p in parts["part"]])
    latent = L.Latent(items, (total[:, : L.CORPUS_RANK], total[:, L.CORPUS_RANK], parts["passages"][0]))
    assert latent.centres is not None
    hasher = L.Hasher()
    flat, starts, owner, place = L._blocks([hasher.ids(t) for t in docs])
    w, _, _ = latent.project(L._terms(flat), starts, owner, place)
    row, item, _ = latent.near(w)
    sims = w @ latent.windows.T
    true = {(int(r), int(i)) for r, i in zip(*np.nonzero(sims > 0.8))}
    got = set(zip(row.tolist(), item.tolist()))
    assert true and len(true & got) >= 0.95 * len(true)


def test_paraphrases(spark):
    docs, items = make(6)
    rng = random.Random(7)
    told = []
    for i, kind, text in items[:8]:
        w = text.split()
        for at in range(3, len(w), 4):  # every fourth word is another one: no run of four is left
            w[at] = f"word{rng.randrange(800)}"
        told.append((1000 + i, " ".join(w), "c", "c"))
    found = L.verdicts(L.find_leaks(spark.createDataFrame(docs + told, DOCS), spark.createDataFrame(items, ITEMS))).where("doc_id >= 1000").collect()
    assert {(r.doc_id - 1000, r.item_id) for r in found if r.kind == "paraphrase"} >= {(i, i) for i in range(6)} and all(r.doc_id - 1000 == r.item_id for r in found)


def test_partial_sums_are_added_in_a_tree(spark, monkeypatch):
    docs, _ = make(8)
    df = spark.createDataFrame(docs, DOCS)
    one = L.corpus_sketch(df.coalesce(1))
    monkeypatch.setattr(L, "FAN_IN", 2)
    tree = L.corpus_sketch(df.repartition(7))
    assert one[2] == tree[2] and np.allclose(one[0], tree[0], rtol=1e-3, atol=1e-2) and np.allclose(one[1], tree[1])
