"""Queries over references to absent records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import references
from quillgraph.session import read_table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.missing_documents(*(read_table(spark, sf_dir, t) for t in ("queries", "local_entities", "documents")))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_report(p3_found(spark, sf_dir))


def p3_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose (article, object) names no entity record; a literal's object is null, so it refers to the article alone (MATCH PARTIAL)."""
    facts, entities = (read_table(spark, sf_dir, t) for t in ("facts", "local_entities"))
    refs = facts.select("fact_id", "doc_id", "object_local", references.month_of(F.col("extracted_at")).alias("ref_month")).distinct()
    return references.orphan_references(refs, entities, ["doc_id", "object_local"], ["doc_id", "local_id"], ["fact_id", "ref_month"], rule="partial")


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_composite": p3_composite}

_FOUND = r"""
    WITH refs AS (
        SELECT 'queries' AS ref_table, query_id AS ref_id, asked_at AS t, unnest(supporting_doc_ids) AS e FROM queries
        UNION ALL
        SELECT 'local_entities', local_id, extracted_at, doc_id FROM local_entities
    ), spelled AS (
        SELECT DISTINCT ref_table, ref_id, t,
               try_cast(nullif(regexp_extract(e, '^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*(?:[dD][oO][cC][-_ ]?)?0*([0-9]{1,19})[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*$', 1), '') AS bigint) AS doc_id
        FROM refs
    )
    SELECT DISTINCT ref_table, ref_id, doc_id, coalesce(strftime(t, '%Y-%m'), 'none') AS ref_month
    FROM spelled s
    WHERE doc_id IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM documents d WHERE d.doc_id = s.doc_id
        AND (s.t IS NULL OR ((d.loaded_at IS NULL OR d.loaded_at <= s.t) AND (d.deleted_at IS NULL OR d.deleted_at > s.t))))
"""

ORACLE_SQL = {
    "p3_found": _FOUND,
    "p3_report": f"SELECT ref_table, ref_month, count(*) AS n_orphans, count(DISTINCT doc_id) AS n_documents FROM ({_FOUND}) GROUP BY ref_table, ref_month",
    "p3_composite": """
        SELECT DISTINCT fact_id, coalesce(strftime(extracted_at, '%Y-%m'), 'none') AS ref_month, doc_id, object_local,
               if(doc_id IS NULL, '0', '1') || if(object_local IS NULL, '0', '1') AS ref_mask
        FROM facts f
        WHERE (doc_id IS NOT NULL OR object_local IS NOT NULL) AND NOT EXISTS (
            SELECT 1 FROM local_entities e WHERE (f.doc_id IS NULL OR e.doc_id = f.doc_id) AND (f.object_local IS NULL OR e.local_id = f.object_local))""",
}
