from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import split as S

DOCS = "doc_id bigint, text string, source string, size string"
CONF = "source string, run_name string, chunk_size int, chunk_overlap int, pack_tokens int"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "c.", "d!", "e\n\n", "Dr.", "x? "]), max_size=60), st.integers(1, 12), st.integers(0, 11))
def test_pieces_follow_the_rules(words, size, overlap):
    overlap = min(overlap, size - 1)
    text = " ".join(words)
    pieces = S.split_text(text, size, overlap)
    tokens = [m.group() for m in S._TOKEN.finditer(text)]
    assert pieces[0][0] == 0 and pieces[-1][1] == len(tokens)
    if len(tokens) <= size:
        assert pieces == [(0, len(tokens), "whole", text)]
        return
    ends = set(S.boundaries(text, [m.start() for m in S._TOKEN.finditer(text)], [m.end() for m in S._TOKEN.finditer(text)])[0])
    for (a, b, cut, piece), nxt in zip(pieces, [*pieces[1:], None]):
        assert 0 < b - a <= size
        assert [m.group() for m in S._TOKEN.finditer(piece)] == tokens[a:b]
        if nxt:
            assert nxt[0] == b - overlap
            usable = [e for e in ends if a + overlap < e <= a + size]
            assert b == (max(usable) if usable else a + size)
            assert (cut == "hard") == (b not in ends)


def test_documents(spark):
    long = "one two three. four five six seven　eight"
    docs = spark.createDataFrame([(1, long, "s", "x"), (1, long, "s", "x"), (2, None, "s", "x"), (3, "", None, "x"), (4, "a b", "none", "x"), (None, long, "s", "x"), (5, " ", "s", "x")], DOCS)
    conf = spark.createDataFrame([("s", "r", 4, 1, None), ("t", "r", None, None, None), (None, "r", 1, 0, 1)], CONF)
    rows = S.split_documents(docs, conf).collect()
    assert sorted((r.start_token, r.end_token, r.cut) for r in rows if r.doc_id == 1) == sorted([(0, 3, "sentence"), (2, 6, "hard"), (5, 8, "end")] * 2)
    assert {(r.doc_id, r.piece, r.end_token) for r in rows if r.doc_id in (2, 3, 4, 5)} == {(2, None, 0), (3, "", 0), (4, "a b", 2), (5, " ", 0)}
    assert sum(r.doc_id is None for r in rows) == 3
    assert S.split_oversized(docs, conf).select("doc_id").distinct().count() == 2
    assert S.split_documents(docs.limit(0), conf).count() == 0
    assert S.split_documents(docs, conf.limit(0)).where("n_pieces > 1").count() == 0


def test_paragraph_and_abbreviation():
    text = "a b\n\nc Dr. X y z w"
    assert [p[:3] for p in S.split_text(text, 5, 0)] == [(0, 2, "paragraph"), (2, 7, "hard"), (7, 8, "end")]


def test_overlap_that_leaves_no_room_is_bounded(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "s", "x")], DOCS)
    conf = spark.createDataFrame([("s", "r", 2, 9, None)], CONF)
    assert [(r.start_token, r.end_token) for r in S.split_oversized(docs, conf).orderBy("piece_no").collect()] == [(0, 2), (1, 3), (2, 4), (3, 5)]
