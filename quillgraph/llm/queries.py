"""Queries of the training-data operators: each runs over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import abuse, groups, leakage, names, neardup, neighbours, packing, split
from quillgraph.session import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the splitter had to cut: those with a second piece."""
    pieces = split.split_oversized(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "data_config"))
    return pieces.where("piece_no = 1").select("doc_id")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "data_config"))


def p1_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How pieces of oversized texts end: at a paragraph, a sentence, the text's end or a hard cut."""
    pieces = split.split_oversized(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "data_config"))
    return pieces.groupBy("cut").agg(F.count("*").alias("n_pieces"), F.sum((F.col("end_token") - F.col("start_token")).cast("bigint")).alias("n_tokens"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.entity_groups(read_table(spark, sf_dir, "identities"), read_table(spark, sf_dir, "local_entities"))


def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups of each size, all keys counted."""
    sizes = groups.connected_groups(read_table(spark, sf_dir, "identities")).groupBy("group_id").agg(F.count("*").alias("group_size"))
    return sizes.groupBy("group_size").agg(F.count("*").alias("n_groups"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variant_pairs(names.resolve_names(read_table(spark, sf_dir, "local_entities")))


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record: its cluster and how many records the cluster has."""
    resolved = names.resolve_names(read_table(spark, sf_dir, "local_entities"))
    sizes = resolved.groupBy("cluster").agg(F.count("*").alias("n_records"), F.countDistinct("name").alias("n_spellings"))
    return resolved.join(sizes, "cluster").select("local_id", "cluster", "n_records", "n_spellings")


def p4_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling of a cluster, by its smallest record, linked to the cluster's most frequent spelling; p4_clusters has the members."""
    return names.spelling_pairs(names.resolve_names(read_table(spark, sf_dir, "local_entities")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.NearDuplicates(read_table(spark, sf_dir, "documents"), shingle=3, threshold=0.5).document_pairs()


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: class of exact copies and number of links at five words and 0.8."""
    return neardup.NearDuplicates(read_table(spark, sf_dir, "documents")).membership()


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document at the parameters of p5_found: class of exact copies, size of the class, links of its text to other texts."""
    return neardup.NearDuplicates(read_table(spark, sf_dir, "documents"), shingle=3, threshold=0.5).membership()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbour_pairs(read_table(spark, sf_dir, "embedding_vectors"))


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every usable vector with their similarity and rank."""
    return neighbours.nearest_neighbours(read_table(spark, sf_dir, "embedding_vectors"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "data_config"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, items and the used share of their room."""
    return packing.fill(p7_packed(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = leakage.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return leaks.where(F.col("containment") >= leakage.SHARE).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item: documents that hold it whole, in part or as a paraphrase."""
    leaks = leakage.verdicts(leakage.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))
    return leaks.groupBy("item_id", "kind").agg(F.count("*").alias("n_documents"))


def p8_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item in other words: near in the latent space, its words in common order, and its answer if it has one."""
    leaks = leakage.verdicts(leakage.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))
    return leaks.where("kind = 'paraphrase'").select("doc_id", "item_id", "cosine", "lcs")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.source_rates(p9_scores(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_cuts": p1_cuts,
    "p2_found": p2_found,
    "p2_sizes": p2_sizes,
    "p4_found": p4_found,
    "p4_clusters": p4_clusters,
    "p4_spellings": p4_spellings,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_neighbours": p6_neighbours,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p8_paraphrases": p8_paraphrases,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
}

_SPACE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

_COMPONENTS = """
    WITH RECURSIVE e AS (
        SELECT left_local AS a, right_local AS b FROM identities WHERE left_local IS NOT NULL AND right_local IS NOT NULL
        UNION SELECT right_local, left_local FROM identities WHERE left_local IS NOT NULL AND right_local IS NOT NULL
    ), reach(k, r) AS (
        SELECT a, a FROM e
        UNION SELECT e.b, reach.r FROM reach JOIN e ON reach.k = e.a
    )
"""

ORACLE_SQL: dict[str, str] = {
    "p1_found": rf"""
        SELECT d.doc_id
        FROM documents d LEFT JOIN data_config c ON d.source = c.source
        WHERE len(list_filter(regexp_split_to_array(d.text, '{_SPACE}'), lambda x: x <> '')) > coalesce(c.chunk_size, 512)
    """,
    "p2_found": f"""{_COMPONENTS} SELECT k AS local_id, min(r) AS group_id FROM reach WHERE k IN (SELECT local_id FROM local_entities) GROUP BY k""",
    "p2_sizes": f"""{_COMPONENTS}, lab AS (SELECT k, min(r) AS g FROM reach GROUP BY k), size AS (SELECT g, count(*) AS group_size FROM lab GROUP BY g)
        SELECT group_size, count(*) AS n_groups FROM size GROUP BY group_size""",
}
