"""Queries over texts, ids and list columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import references
from quillgraph.session import read_table

#: White space class for DuckDB patterns.
SQL_SPACE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = T.chunk_windows(read_table(spark, sf_dir, "documents"))
    return chunks.select("doc_id", "chunk_start", "n_tokens", F.sha2("chunk", 256).alias("chunk_hash"))


def stable_doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.stable_id("doc-", 16, doc_id=F.col("doc_id"), lang=F.coalesce("lang", F.lit("und"))).alias("stable_id"))


def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.spaced_digest(doc_id=F.col("doc_id"), lang=F.col("lang"), n_chars=F.col("n_chars")).alias("digest"))


def _titled(docs: DataFrame) -> DataFrame:
    return docs.where("title is not null").select("doc_id", "text", F.lower(T.collapse(F.col("title"))).alias("title_key")).where("title_key <> ''")


def first_doc_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each title, and how many later ones repeat or contradict its text."""
    titled = _titled(read_table(spark, sf_dir, "documents")).withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256))
    first = titled.groupBy("title_key").agg(F.min("doc_id").alias("doc_id"), F.min_by("h", "doc_id").alias("_h"), F.count("*").alias("n"))
    per = titled.groupBy("title_key", "h").agg(F.count("*").alias("m"))
    same = first.join(per.select("title_key", F.col("h").alias("_h"), "m"), ["title_key", "_h"])
    return same.select("title_key", "doc_id", (F.col("m") - 1).alias("n_repeats"), (F.col("n") - F.col("m")).alias("n_conflicts"))


def ordered_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per question its distinct supporting documents in order of first mention."""
    q = read_table(spark, sf_dir, "queries").select("query_id", "supporting_doc_ids").distinct()
    e = q.select("query_id", F.posexplode("supporting_doc_ids").alias("pos", "element")).withColumn("doc", references.spelled_id(F.col("element"))).where("doc is not null")
    first = e.groupBy("query_id", "doc").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("query_id").orderBy("pos", "doc")
    return first.select("query_id", "doc", F.row_number().over(w).alias("place"))


def role_inverses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation labels with the inverse that the kinship rules give them, or none."""
    labels = read_table(spark, sf_dir, "facts").groupBy("raw_relation").agg(F.count("*").alias("n_rows"))
    return labels.select("raw_relation", "n_rows", T.role_inverse(F.col("raw_relation")).alias("inverse"))


def answer_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct answers with their normalised words."""
    a = read_table(spark, sf_dir, "queries").select(F.explode("answers").alias("answer")).where("answer is not null").distinct()
    return a.select("answer", F.array_join(T.answer_tokens(F.col("answer")), " ").alias("normalised"))


QUERIES = {
    "chunk_windows": chunk_windows,
    "stable_doc_ids": stable_doc_ids,
    "content_digests": content_digests,
    "first_doc_wins": first_doc_wins,
    "ordered_support": ordered_support,
    "role_inverses": role_inverses,
    "answer_words": answer_words,
}

def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SQL_SPACE}+', ' ', 'g'))"


def sql_answer(c: str) -> str:
    bare = f"regexp_replace(lower({c}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    return f"list_filter(regexp_split_to_array({bare}, '{SQL_SPACE}+'), lambda t: t NOT IN ('', 'a', 'an', 'the'))"


def sql_role_inverse(c: str) -> str:
    """Kinship inverse in SQL, read from the ends of the label; role words are composed here, not taken from the code."""
    r = f"lower({sql_collapse(c)})"
    own = f"({r} LIKE 'has %' OR {r} LIKE 'had %')"
    past = f"({r} LIKE 'was %' OR {r} LIKE 'had %')"
    be = f"({r} LIKE '% of' OR {r} LIKE '% to')"
    phrase = f"regexp_replace(regexp_replace(CASE WHEN {own} THEN {r} ELSE left({r}, -3) END, '^(is|was|has|had) ', ''), '^(a|an|the) ', '')"
    roles = (
        "(['wife','husband','spouse','brother','sister','sibling','uncle','aunt','nephew','niece'] || "
        "flatten([[g || x for x in ['father','mother','parent','son','daughter','child']] for g in ['','grand','great-grand']]))"
    )
    order = "(['first','second','third','fourth','fifth','sixth','seventh','eighth'] || ['eldest','oldest','elder','older','youngest','younger'] || ['full','half','only','maternal','paternal','biological','adoptive'])"
    kin = f"list_contains({roles}, list_last(string_split({phrase}, ' '))) AND len(list_filter(string_split({phrase}, ' ')[:-2], lambda m: NOT list_contains({order}, m))) = 0"
    return f"""CASE
        WHEN NOT ({own} OR {be}) OR NOT ({kin}) THEN NULL
        WHEN {own} THEN if({past}, 'was ', 'is ') || {phrase} || ' of'
        WHEN {r} LIKE '% of' AND {phrase} IN ('mother', 'father', 'parent') THEN if({past}, 'was child of', 'is child of')
        WHEN {r} LIKE '% of' AND {phrase} IN ('son', 'daughter', 'child') THEN if({past}, 'was parent of', 'is parent of')
        ELSE if({past}, 'had as ', 'has as ') || {phrase} END"""


ORACLE_SQL = {
    "chunk_windows": rf"""
        WITH t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{SQL_SPACE}+'), lambda x: x <> '') AS k FROM documents WHERE text IS NOT NULL),
        s AS (SELECT doc_id, text, k, len(k) AS n, unnest(CASE WHEN len(k) <= 512 THEN [0] ELSE range(0, len(k), 448) END) AS s FROM t)
        SELECT doc_id, s AS chunk_start, least(512, n - s) AS n_tokens,
               sha256(CASE WHEN n <= 512 THEN text ELSE array_to_string(k[s + 1:s + 512], ' ') END) AS chunk_hash FROM s""",
    "stable_doc_ids": """SELECT doc_id, 'doc-' || substr(sha256('{"doc_id":' || doc_id || ',"lang":"' || coalesce(lang, 'und') || '"}'), 1, 16) AS stable_id FROM documents""",
    "content_digests": """SELECT doc_id, sha256('{"doc_id": ' || doc_id || ', "lang": ' || coalesce('"' || lang || '"', 'null') || ', "n_chars": ' || coalesce(n_chars::VARCHAR, 'null') || '}') AS digest FROM documents""",
    "first_doc_wins": f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x, lower({sql_collapse('title')}) AS title_key FROM documents WHERE title IS NOT NULL),
        f AS (SELECT *, first_value(x) OVER w AS fx, first_value(doc_id) OVER w AS fd FROM t WHERE title_key <> '' WINDOW w AS (PARTITION BY title_key ORDER BY doc_id))
        SELECT title_key, fd AS doc_id, count(*) FILTER (x = fx) - 1 AS n_repeats, count(*) FILTER (x <> fx) AS n_conflicts FROM f GROUP BY title_key, fd""",
    "ordered_support": rf"""
        WITH q AS (SELECT DISTINCT query_id, supporting_doc_ids AS l FROM queries),
        e AS (SELECT query_id, unnest(l) AS e, generate_subscripts(l, 1) AS pos FROM q),
        d AS (SELECT query_id, pos, try_cast(nullif(regexp_extract(e, '^{SQL_SPACE}*(?:[dD][oO][cC][-_ ]?)?0*([0-9]{{1,19}}){SQL_SPACE}*$', 1), '') AS bigint) AS doc FROM e)
        SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY min(pos), doc) AS place FROM d WHERE doc IS NOT NULL GROUP BY query_id, doc""",
    "role_inverses": f"SELECT raw_relation, count(*) AS n_rows, {sql_role_inverse('raw_relation')} AS inverse FROM facts GROUP BY raw_relation",
    "answer_words": f"SELECT answer, array_to_string({sql_answer('answer')}, ' ') AS normalised FROM (SELECT DISTINCT unnest(answers) AS answer FROM queries) WHERE answer IS NOT NULL",
}
