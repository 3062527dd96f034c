import unicodedata

from pyspark.sql import functions as F

from quillgraph.functions import text as T


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_norm(spark):
    values = [None, "", "  A B ", "Straße", "ﬁne　X", "Ⅳ", "plain"]
    expected = [None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split()) for v in values]
    assert column(spark, values, T.norm) == expected


def test_role_inverse(spark):
    cases = {
        "is the mother of": "is child of", "was son of": "was parent of", "child of": "is parent of", "is wife of": "has as wife", "was the elder brother of": "had as elder brother",
        "has son": "is son of", "had a maternal uncle": "was maternal uncle of", "was born in": None, "": None, None: None,
        "the mother to": "has as mother", "of": None, "has": None, "has a": None, "is the of": None, "wife": None, "first of": None, "old brother of": None, "Is  The Great-Grandson Of": "has as great-grandson",
    }
    assert column(spark, list(cases), T.role_inverse) == list(cases.values())


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, " a  b "), (3, ""), (4, None)], "doc_id bigint, text string")
    got = [(r.doc_id, r.chunk_start, r.n_tokens, r.chunk) for r in T.chunk_windows(docs, 3, 1).orderBy("doc_id", "chunk_start").collect()]
    assert got == [(1, 0, 3, "a b c"), (1, 2, 3, "c d e"), (1, 4, 3, "e f g"), (1, 6, 1, "g"), (2, 0, 2, " a  b "), (3, 0, 0, "")]


def test_answer_tokens(spark):
    assert column(spark, ["The U.S. Army!", "a an the", None, "Yes"], lambda c: F.array_join(T.answer_tokens(c), " ")) == ["us army", "", None, "yes"]


def test_stable_id_ignores_argument_order(spark):
    df = spark.range(1).select(T.stable_id("doc-", 16, b=F.lit(1), a=F.lit("x")).alias("p"), T.stable_id("doc-", 16, a=F.lit("x"), b=F.lit(1)).alias("q"))
    p, q = df.first()
    assert p == q and p.startswith("doc-") and len(p) == 20
