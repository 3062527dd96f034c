import random

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import neardup as N
from quillgraph.llm.words import Hasher, words

DOCS = "doc_id bigint, text string, rep string, a string"


def brute(rows, k, t):
    sets = {i: {tuple(words(x)[j : j + k]) for j in range(len(words(x)) - k + 1)} for i, x in rows if x is not None and i is not None}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, max(1, len(w) // 8))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[len(w) // 3 :] + w[: len(w) // 3]
        else:
            w = rng.choices(vocabulary, k=rng.randrange(3, 150))
        rows.append((i, " ".join(w)))
    return rows


def found(spark, rows, k, t):
    df = spark.createDataFrame([(i, x, "c", "c") for i, x in rows], DOCS)
    return sorted(tuple(r) for r in N.NearDuplicates(df, k, t).document_pairs().collect())


def test_equals_brute_force(spark):
    rows = corpus(1)
    got = found(spark, rows, 3, 0.5)
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3, 0.5)


def test_default_parameters(spark):
    rows = corpus(2)
    assert set(found(spark, rows, N.SHINGLE, N.THRESHOLD)) == brute(rows, 5, 0.8)


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "one two"), (4, "one two three"), (5, "One, TWO; three!"), (5, "One, TWO; three!"), (None, "one two three"), (6, long), (7, long + " end")]
    assert set(found(spark, rows, 3, 0.5)) == {(4, 5), (6, 7)}
    assert found(spark, [], 3, 0.5) == []


def test_large_copy_class_is_a_star(spark):
    rows = [(i, "same words in every copy") for i in range(N.EXPAND_COPIES + 10)] + [(500, "same words in every copy here")]
    got = found(spark, rows, 3, 0.5)
    assert got == sorted([(0, i) for i in range(1, N.EXPAND_COPIES + 10)] + [(0, 500)])
    df = spark.createDataFrame([(i, x, "c", "c") for i, x in rows], DOCS)
    members = {r.doc_id: tuple(r) for r in N.NearDuplicates(df, 3, 0.5).membership().collect()}
    assert members[3] == (3, 0, N.EXPAND_COPIES + 10, 1) and members[500] == (500, 500, 1, 1)


def test_copies_can_be_written_out_in_full(spark):
    rows = [(i, "same words in every copy") for i in range(N.EXPAND_COPIES + 6)] + [(500, "same words in every copy here")]
    df = spark.createDataFrame([(i, x, "c", "c") for i, x in rows], DOCS)
    assert {tuple(r) for r in N.NearDuplicates(df, 3, 0.5).document_pairs(expand_copies=None).collect()} == brute(rows, 3, 0.5)


def met(a, b, tau):
    """Whether two signatures share a posting whose chain stays within its budgets."""
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "minima": pa.array([a.tobytes(), b.tobytes()], pa.binary())})
    rows = next(N._postings(tau)(iter([batch]))).to_pandas()
    both = rows[rows.doc == 1].merge(rows[rows.doc == 2], on="key")
    for x, y in zip(both.chain_x, both.chain_y):
        d = [(int(x) >> 4 * i & 15) != (int(y) >> 4 * i & 15) for i in range(N.CHAIN * N.ROWS)]
        if all(sum(d[: n * N.ROWS]) <= n * tau // N.SEGMENTS for n in range(1, N.CHAIN + 1)):
            return True
    return False


@pytest.mark.parametrize("threshold", [0.5, 0.65, 0.8])
def test_no_pair_within_the_hamming_budget_is_lost(threshold):
    rng = np.random.default_rng(0)
    tau = N.budget(threshold)
    positions = N.SEGMENTS * N.ROWS
    for trial in range(150):
        a = rng.integers(0, 1 << 16, positions).astype(np.uint16)
        b = a.copy()
        # the hardest pairs: exactly at the budget, spread evenly or at random
        at = rng.choice(positions, int(tau), replace=False) if trial % 2 else (np.arange(int(tau)) * positions // int(tau) + trial) % positions
        b[at] ^= np.uint16(15)
        assert met(a, b, tau)


def test_minima_do_not_depend_on_slices():
    s = N.shingles(np.arange(10_000, dtype=np.uint64) * np.uint64(2654435761), 3)
    parts = np.minimum(N.minima(s[:5000]), N.minima(s[5000:]))
    assert (N.minima(s) == parts).all()
    assert len(Hasher().ids(None)) == 0
