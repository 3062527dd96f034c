import numpy as np
import pytest

from quillgraph.llm import packing as P
from quillgraph.llm import queries as Q
from tests.oracle import SF_DIR

DOCS = "doc_id bigint, text string, source string, capacity string"
CONF = "source string, pack_tokens int"


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_every_constraint_holds_and_room_is_used(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 400, 3000)
    where, offset = P.best_fit(lengths, 1000)
    used = np.bincount(where, lengths)
    assert used.max() <= 1000 and np.bincount(where).max() <= P.MAX_DOCUMENTS
    assert used.sum() / (1000 * len(used)) > 0.99
    few = P.best_fit(lengths, 1000, max_documents=8)[0]
    assert np.bincount(few, lengths).max() <= 1000 and np.bincount(few).max() <= 8
    for c in range(0, len(used), 37):  # no two items of a container overlap
        mine = np.flatnonzero(where == c)
        spans = sorted((offset[i], offset[i] + lengths[i]) for i in mine)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= 1000


def test_attention_capacity():
    where, _ = P.best_fit(np.full(10, 50), 100, attention=0.3)
    assert np.bincount(where).max() == 1
    lengths = np.random.default_rng(4).integers(1, 900, 4000)
    free, bound = (P.best_fit(lengths, 1000, attention=a)[0] for a in (1.0, P.ATTENTION_SHARE))
    cost = lambda w: np.bincount(w, lengths.astype(float) ** 2)
    assert not np.array_equal(free, bound)
    first = np.zeros(bound.max() + 1)
    np.maximum.at(first, bound, lengths)
    assert (cost(bound) <= np.maximum(P.ATTENTION_SHARE * 1000**2, first**2 + P.ATTENTION_SHARE * (1000 - first) ** 2) + 1e-6).all()
    assert (cost(free) > P.ATTENTION_SHARE * 1000**2).sum() > (cost(bound) > P.ATTENTION_SHARE * 1000**2).sum()


def test_fill_over_whole_texts(spark):
    """Every token of every text is in exactly one container, no capacity is exceeded and little room is left."""
    packed = Q.p7_packed(spark, SF_DIR).cache()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    total = sum(P.token_counts([r.text for r in docs.select("text").collect()]))
    assert sum(r.n_tokens for r in packed.select("n_tokens").collect()) == total
    assert P.broken_containers(packed).count() == 0
    row = P.fill(packed).first()
    assert row.n_containers <= 1.03 * total / row.capacity + 1
    packed.unpersist()


def test_documents(spark):
    text = "The quick brown fox jumps over the lazy dog. " * 40
    docs = spark.createDataFrame([(1, text, "s", "x"), (2, None, "s", "x"), (3, "", None, "x"), (4, "short text", "s", "x"), (4, "short text", "s", "x"), (5, text, "other", "x"), (None, "a b", "s", "x")], DOCS)
    conf = spark.createDataFrame([("s", 100), ("t", None), (None, 5)], CONF)
    rows = P.pack(docs, conf).collect()
    n = P.token_counts([text])[0]
    first = sorted((r.piece_no, r.n_tokens) for r in rows if r.doc_id == 1)
    assert sum(k for _, k in first) == n and [k for _, k in first[:-1]] == [100] * (len(first) - 1)
    assert [(r.n_tokens, r.capacity) for r in rows if r.doc_id == 5] == [(n, P.DEFAULT_TOKENS)]
    assert sorted(r.doc_id for r in rows if r.doc_id in (2, 3, 4)) == [4, 4] and sum(r.doc_id is None for r in rows) == 1
    used = {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.n_tokens
        assert used[r.container] <= r.capacity
    assert P.pack(docs.limit(0), conf).count() == 0


def test_counts_are_a_round_trip():
    enc = P.encoder()
    for t in ["", "a", "naïve  café\n\n123", "　"]:
        ids = enc.encode_ordinary(t)
        assert enc.decode(ids) == t and P.token_counts([t]) == [len(ids)]
