import numpy as np
import pytest

from quillgraph.llm import queries as Q
from quillgraph.llm.words import words
from tests.oracle import SF_DIR, connection, same_rows


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    same_rows(Q.QUERIES[name](spark, SF_DIR), con, Q.ORACLE_SQL[name])


@pytest.mark.parametrize(("name", "columns"), [("p1_found", ["doc_id"]), ("p2_found", ["local_id", "group_id"]), ("p4_found", ["local_id_a", "local_id_b"]), ("p5_found", ["doc_id_a", "doc_id_b"]), ("p6_found", ["vector_key_a", "vector_key_b"]), ("p8_found", ["doc_id", "item_id"]), ("p9_found", ["doc_id"])])
def test_result_columns(spark, name, columns):
    df = Q.QUERIES[name](spark, SF_DIR)
    assert df.columns == columns
    rows = df.collect()
    assert len(rows) == len(set(rows))


def table(spark, name):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")


def test_pieces_leave_no_gap(spark):
    """Every text's pieces follow each other, share the overlap, keep the limit and end where the text ends."""
    limits = {r.source: (r.chunk_size, r.chunk_overlap) for r in table(spark, "data_config").collect()}
    docs = {r.doc_id: r for r in table(spark, "documents").select("doc_id", "source", "text").collect()}
    pieces = {}
    for r in Q.p1_pieces(spark, SF_DIR).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(docs)
    for doc_id, mine in pieces.items():
        size, overlap = limits.get(docs[doc_id].source, (None, None))
        size, overlap = size or 512, 64 if overlap is None else overlap
        mine.sort(key=lambda r: r.piece_no)
        n = len((docs[doc_id].text or "").split())
        assert mine[0].start_token == 0 and mine[-1].end_token == n and [r.piece_no for r in mine] == list(range(len(mine)))
        assert all(b.start_token == a.end_token - overlap and b.end_token > a.end_token for a, b in zip(mine, mine[1:]))
        assert all(r.end_token - r.start_token <= size for r in mine)


def test_near_duplicates_equal_brute_force(spark):
    sets = {r.doc_id: {tuple(w[i : i + 3]) for w in [words(r.text)] for i in range(len(w) - 2)} for r in table(spark, "documents").collect()}
    ids = sorted(i for i in sets if sets[i])
    true = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert {tuple(r) for r in Q.p5_found(spark, SF_DIR).collect()} == true


def test_leaks_equal_brute_force(spark):
    grams = lambda t: {tuple(w[i : i + 4]) for w in [words(t)] for i in range(len(w) - 3)}
    items = {r.item_id: grams(r.text) for r in table(spark, "benchmark").collect()}
    docs = {r.doc_id: grams(r.text) for r in table(spark, "documents").collect()}
    true = {(d, i) for d, x in docs.items() for i, y in items.items() if y and len(x & y) >= 0.35 * len(y)}
    assert {tuple(r) for r in Q.p8_found(spark, SF_DIR).collect()} == true


def test_neighbours_have_high_recall(spark):
    latest = {}
    for r in table(spark, "embedding_vectors").collect():
        if r.vector_key not in latest or r.created_at >= latest[r.vector_key][0]:
            latest[r.vector_key] = (r.created_at, r.vector)
    v = {k: np.array(x, float) for k, (_, x) in latest.items() if x is not None and len(x) == 64 and np.isfinite(np.array(x, float)).all() and any(x)}
    keys = sorted(v)
    m = np.stack([v[k] / np.linalg.norm(v[k]) for k in keys])
    s = m @ m.T
    np.fill_diagonal(s, -2)
    true = {tuple(sorted((keys[i], keys[j]))) for i in range(len(keys)) for j in np.argsort(-s[i])[:5]}
    got = {tuple(r) for r in Q.p6_found(spark, SF_DIR).collect()}
    assert len(got & true) >= 0.9 * len(true) and len(got & true) >= 0.9 * len(got)


def test_scores_are_shares(spark):
    rows = Q.p9_scores(spark, SF_DIR).collect()
    assert len(rows) == table(spark, "documents").count() and all(0 <= r.score <= 1 for r in rows)


def test_names_form_clusters(spark):
    """Every found pair lies in one cluster, and every cluster's spellings hang on its most frequent one."""
    of = {r.local_id: r.cluster for r in Q.p4_clusters(spark, SF_DIR).collect()}
    assert all(of[r.local_id_a] == of[r.local_id_b] and r.local_id_a < r.local_id_b for r in Q.p4_found(spark, SF_DIR).collect())
    assert all(of[r.local_id] == r.cluster for r in Q.p4_spellings(spark, SF_DIR).collect())
