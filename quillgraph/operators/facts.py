"""Facts of articles as graph tables: validation, routing, entities, occurrences, views, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import display_name, norm, role_inverse, stable_id

KINDS = ("ENTITY_LINK", "ENTITY_TO_DETAIL", "DETAIL_TO_ENTITY", "TEXT_FACT", "SAME_ENTITY")


def distinct_facts(facts: DataFrame) -> DataFrame:
    """The columns of a fact that the graph uses, each fact once (deliveries differ in times only)."""
    return facts.select("fact_id", "doc_id", "subject_local", "object_local", "relation", "raw_relation", "literal_raw", "literal_type", "fact_kind", "source_type", "source_direction", "inverse_relation").distinct()


def faults() -> Column:
    """Codes of the rules that a fact row breaks; empty for a valid row."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    rules = [
        (~F.coalesce(F.col("source_type").isin(*KINDS), F.lit(False)), "kind"),
        (blank("subject_local"), "subject"),
        (blank("raw_relation"), "relation"),
        (F.col("object_local").isNull() == F.col("literal_raw").isNull(), "object_xor_literal"),
        ((F.col("source_type") == "ENTITY_LINK") & F.col("object_local").isNull(), "link_without_object"),
        (F.col("source_type").isin("ENTITY_TO_DETAIL", "DETAIL_TO_ENTITY") & F.col("object_local").isNotNull(), "detail_with_object"),
        ((F.col("source_type") == "DETAIL_TO_ENTITY") != (F.col("source_direction") == "reverse"), "direction"),
        (F.coalesce(F.col("relation") != F.concat(F.lit("X "), F.col("raw_relation"), F.lit(" Y")), F.lit(True)), "wrapping"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for bad, code in rules]))


def routes(facts: DataFrame) -> DataFrame:
    """Where each fact goes: directed graph, terminal detail, or text with a fallback for a missing inverse."""
    route = (
        F.when(F.col("source_type") == "TEXT_FACT", "text")
        .when(F.col("source_type") == "SAME_ENTITY", "identity")
        .when(F.col("object_local").isNull(), "terminal")
        .when(F.coalesce("inverse_relation", role_inverse(F.col("raw_relation"))).isNull(), "reverse_fallback")
        .otherwise("directed")
    )
    return facts.select("fact_id", "doc_id", "source_type", route.alias("route"))


def entity_groups(local_entities: DataFrame) -> DataFrame:
    """Entities by type and normalised name, shown under the most frequent spelling (ties: smallest).

    Counts are aggregated per spelling before anything is ranked, so a hot name is one row a spelling.
    """
    spelled = local_entities.where("name is not null").select("local_id", "type", display_name(F.col("name")).alias("spelling")).distinct()
    counted = spelled.groupBy("type", "spelling").agg(F.count("*").alias("n"))
    keyed = counted.withColumn("name_key", norm(F.col("spelling")))
    best = F.min_by("spelling", F.struct(-F.col("n"), F.col("spelling")))
    grouped = keyed.groupBy("type", "name_key").agg(best.alias("entity_name"), F.sum("n").alias("n_records"), F.count("*").alias("n_spellings"))
    return grouped.withColumn("entity_id", stable_id("E_", 20, name=F.col("entity_name"), type=F.col("type")))


def occurrences(local_entities: DataFrame) -> DataFrame:
    """(occurrence_id, local_id, doc_id, role, text) of every mention."""
    m = local_entities.select("local_id", "doc_id", F.explode("mentions").alias("m"))
    return m.select(F.col("m.occurrence_id").alias("occurrence_id"), "local_id", "doc_id", F.substring_index("m.occurrence_id", ":", -1).alias("role"), F.col("m.name").alias("text")).distinct()


def context_facts(facts: DataFrame, local_entities: DataFrame) -> DataFrame:
    """(local_id, n_contexts, first_context, last_context): how many distinct `subject | relation | object` lines a record has, and the first and last of them; ``context_lines`` has them all."""
    name = local_entities.where("local_id is not null").groupBy("local_id").agg(F.min("name").alias("name"))
    f = distinct_facts(facts)
    s = f.join(name.select(F.col("local_id").alias("subject_local"), F.col("name").alias("sn")), "subject_local")
    o = s.join(name.select(F.col("local_id").alias("object_local"), F.col("name").alias("on")), "object_local", "left")
    line = F.concat_ws(" | ", "sn", "raw_relation", F.coalesce("on", "literal_raw"))
    both = o.select(F.explode(F.array_compact(F.array("subject_local", "object_local"))).alias("local_id"), line.alias("line"))
    distinct = both.distinct()
    return distinct.groupBy("local_id").agg(F.count("*").alias("n_contexts"), F.min("line").alias("first_context"), F.max("line").alias("last_context"))


def context_lines(facts: DataFrame, local_entities: DataFrame) -> DataFrame:
    """(local_id, place, line): the distinct lines of each record in order, `subject | relation | object` and, in brackets, the qualifiers by key.

    One row a line, so a hot record is many rows and no long list.
    """
    name = local_entities.where("local_id is not null").groupBy("local_id").agg(F.min("name").alias("name"))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("qualifiers")), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit("")))), "; ")
    f = facts.select("subject_local", "object_local", "raw_relation", "literal_raw", F.when(told != "", F.concat(F.lit(" ["), told, F.lit("]"))).otherwise("").alias("told")).distinct()
    s = f.join(name.select(F.col("local_id").alias("subject_local"), F.col("name").alias("sn")), "subject_local")
    o = s.join(name.select(F.col("local_id").alias("object_local"), F.col("name").alias("on")), "object_local", "left")
    line = F.concat(F.concat_ws(" | ", "sn", "raw_relation", F.coalesce("on", "literal_raw")), F.coalesce("told", F.lit("")))
    distinct = o.select(F.explode(F.array_compact(F.array("subject_local", "object_local"))).alias("local_id"), line.alias("line")).distinct()
    return distinct.withColumn("place", F.row_number().over(Window.partitionBy("local_id").orderBy("line"))).select("local_id", "place", "line")


def directed_views(facts: DataFrame) -> DataFrame:
    """Forward or terminal view of every fact, and the reverse view where an inverse label is known."""
    f = distinct_facts(facts)
    inverse = F.coalesce("inverse_relation", role_inverse(F.col("raw_relation")))
    forward = F.struct(
        F.when(F.col("object_local").isNull(), "terminal").otherwise("forward").alias("direction"), F.col("subject_local").alias("from_local"), F.col("object_local").alias("to_local"), F.col("relation").alias("label")
    )
    back = F.when(
        F.col("object_local").isNotNull() & inverse.isNotNull(),
        F.struct(F.lit("reverse").alias("direction"), F.col("object_local").alias("from_local"), F.col("subject_local").alias("to_local"), F.concat(F.lit("X "), inverse, F.lit(" Y")).alias("label")),
    )
    return f.select("fact_id", "doc_id", F.explode(F.array_compact(F.array(forward, back))).alias("v")).select("fact_id", "doc_id", "v.direction", "v.from_local", "v.to_local", "v.label").where("from_local is not null")


def steps(views: DataFrame, mapping: DataFrame) -> DataFrame:
    """Views between canonical nodes; a local without entry in ``mapping`` is its own node."""
    m = mapping.select("local_id", "entity_id")
    a = views.join(m.select(F.col("local_id").alias("from_local"), F.col("entity_id").alias("_f")), "from_local", "left")
    b = a.join(m.select(F.col("local_id").alias("to_local"), F.col("entity_id").alias("_t")), "to_local", "left")
    return b.select("fact_id", "doc_id", "direction", "label", "from_local", "to_local", F.coalesce("_f", "from_local").alias("from_node"), F.coalesce("_t", "to_local").alias("to_node")).distinct()


def inverse_examples(facts: DataFrame, local_entities: DataFrame, limit: int = 3) -> DataFrame:
    """Per relation without inverse at most ``limit`` examples with different endpoint types, first seen first."""
    types = local_entities.where("local_id is not null").groupBy("local_id").agg(F.min("type").alias("type"))
    f = distinct_facts(facts).where("source_type = 'ENTITY_LINK' and inverse_relation is null and object_local is not null")
    t = f.join(types.select(F.col("local_id").alias("subject_local"), F.col("type").alias("subject_type")), "subject_local").join(types.select(F.col("local_id").alias("object_local"), F.col("type").alias("object_type")), "object_local")
    first = t.groupBy("raw_relation", "subject_type", "object_type").agg(F.min(F.struct("doc_id", "fact_id")).alias("x"))
    ranked = first.withColumn("example", F.row_number().over(Window.partitionBy("raw_relation").orderBy("x.doc_id", "x.fact_id")))
    return ranked.where(F.col("example") <= limit).select("raw_relation", "subject_type", "object_type", F.col("x.fact_id").alias("fact_id"), "example")


def fact_report(facts: DataFrame) -> DataFrame:
    """Deliveries, facts, literals and missing inverses by kind."""
    per = facts.groupBy("fact_id").agg(F.min("source_type").alias("source_type"), F.count("*").alias("n"), F.min("object_local").alias("o"), F.min("inverse_relation").alias("i"))
    return per.groupBy("source_type").agg(
        F.count("*").alias("n_facts"), F.sum("n").alias("n_deliveries"), F.count_if(F.col("o").isNull()).alias("n_literals"), F.count_if(F.col("o").isNotNull() & F.col("i").isNull()).alias("n_without_inverse")
    )


def invariant_violations(facts: DataFrame, local_entities: DataFrame) -> DataFrame:
    """Facts whose subject or object is no known local entity, per role and month of extraction."""
    known = local_entities.select(F.col("local_id").alias("ref")).where("ref is not null").distinct()
    f = distinct_facts(facts).select("fact_id", F.explode(F.array(F.struct(F.lit("subject").alias("role"), F.col("subject_local").alias("ref")), F.struct(F.lit("object").alias("role"), F.col("object_local").alias("ref")))).alias("e"))
    return f.select("fact_id", "e.role", "e.ref").where("ref is not null").join(known, "ref", "left_anti").groupBy("role").agg(F.countDistinct("fact_id").alias("n_facts"), F.countDistinct("ref").alias("n_missing"))


def pending_documents(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """Documents with text for which no fact was extracted yet."""
    done = facts.select(F.col("doc_id").try_cast("bigint").alias("doc_id")).distinct()
    return documents.where("trim(text) <> ''").select("doc_id").join(done, "doc_id", "left_anti")
