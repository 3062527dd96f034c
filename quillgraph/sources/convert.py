"""Converters from public multi-hop question sets to corpus and question tables.

Each converter takes rows with a declared schema and returns a ``Converted``: documents (first one
wins), questions with ordered distinct support, documents that contradict an earlier one, and
support titles without document. Everything is a join or an aggregation keyed by dataset ids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import collapse


@dataclass
class Converted:
    documents: DataFrame  # doc_id, title, text
    questions: DataFrame  # query_id, question, answers, supporting_doc_ids, metadata
    conflicts: DataFrame  # doc_id, title, text
    missing: DataFrame  # query_id, title


def sample_rows(rows: DataFrame, id_column: str, most: int | None, seed: int = 0) -> DataFrame:
    """A uniform sample without replacement, chosen by a hash of the id and the seed."""
    if most is None:
        return rows
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}|"), F.col(id_column).cast("string")), 256), id_column).limit(most)


def answer_list(answer: Column) -> Column:
    return F.when(answer.isNull(), F.array().cast("array<string>")).otherwise(F.array(answer.cast("string")))


def first_document_wins(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of (doc_id, title, text, ordinal): the first of each id, and later ones whose text differs."""
    first = candidates.groupBy("doc_id").agg(F.min(F.struct("ordinal", "title", "text")).alias("f"))
    docs = first.select("doc_id", "f.title", "f.text")
    later = candidates.join(first, "doc_id").where("ordinal > f.ordinal and text <> f.text").select("doc_id", "title", "text").distinct()
    return docs, later


def _support(found: DataFrame) -> DataFrame:
    """(query_id, supporting_doc_ids): distinct documents in order of their first place."""
    once = found.groupBy("query_id", "doc_id").agg(F.min("place").alias("place"))
    return once.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"]).alias("supporting_doc_ids"))


def _titled(rows: DataFrame, dataset: str, extra: list[Column]) -> Converted:
    """Rows (id, question, answer, context{title[], sentences[][]}, supporting_facts{title[], sent_id[]})."""
    checked = rows.withColumn("_ok", F.when(F.size("context.title") != F.size("context.sentences"), F.raise_error(F.lit("titles and sentences differ in number"))).otherwise(F.lit(True))).where("_ok")
    numbered = checked.withColumn("_row", F.monotonically_increasing_id())
    para = numbered.select("id", "_row", F.posexplode(F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences"))).alias("pos", "p"))
    docs = para.select(
        "id", F.struct("_row", "pos").alias("ordinal"), collapse(F.col("p.title")).alias("title"), collapse(F.array_join("p.sentences", " ")).alias("text")
    ).withColumn("doc_id", F.concat(F.lit(f"{dataset}:"), "title"))
    documents, conflicts = first_document_wins(docs)
    asked = numbered.select(F.col("id").alias("query_id"), F.posexplode("supporting_facts.title").alias("place", "title")).withColumn("title", collapse(F.col("title")))
    here = docs.select(F.col("id").alias("query_id"), "title", "doc_id").distinct()
    found = asked.join(here, ["query_id", "title"], "left")
    questions = (
        numbered.select(F.col("id").alias("query_id"), F.col("question"), answer_list(F.col("answer")).alias("answers"), F.to_json(F.struct(*extra)).alias("metadata"))
        .join(_support(found.where("doc_id is not null")), "query_id", "left")
        .withColumn("supporting_doc_ids", F.coalesce("supporting_doc_ids", F.array().cast("array<string>")))
    )
    return Converted(documents, questions, conflicts, found.where("doc_id is null").select("query_id", "title").distinct())


def convert_hotpotqa(rows: DataFrame) -> Converted:
    return _titled(rows, "hotpotqa", [F.col("type"), F.col("level")])


def convert_twowiki(rows: DataFrame) -> Converted:
    return _titled(rows, "twowiki", [F.col("type"), F.col("evidences")])


def convert_musique(rows: DataFrame) -> Converted:
    """Rows (id, question, answer, answer_aliases, paragraphs[{idx, title, paragraph_text, is_supporting}], question_decomposition[{paragraph_support_idx}][, answerable]).

    Answers hold the answer alone; aliases, decomposition and the ids of all paragraphs go into metadata.
    Support is the paragraphs of the decomposition steps, in order, then the marked ones; a step that
    names an absent paragraph is an error.
    """
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    para = numbered.select(F.col("id").alias("query_id"), "_row", F.explode("paragraphs").alias("p")).select(
        "query_id", F.struct("_row", "p.idx").alias("ordinal"), F.col("p.idx").alias("idx"), collapse(F.col("p.title")).alias("title"), collapse(F.col("p.paragraph_text")).alias("text"), F.col("p.is_supporting").alias("marked")
    )
    para = para.withColumn("doc_id", F.concat(F.lit("musique:"), "title", F.lit(":"), F.substring(F.md5(F.concat("title", F.lit("\n"), "text")), 1, 12)))
    documents, conflicts = first_document_wins(para.select("doc_id", "title", "text", "ordinal"))
    steps = numbered.select(F.col("id").alias("query_id"), F.posexplode("question_decomposition").alias("pos", "d")).select("query_id", "pos", F.col("d.paragraph_support_idx").alias("idx")).where("idx is not null")
    named = steps.join(para.select("query_id", "idx", "doc_id"), ["query_id", "idx"], "left")
    named = named.select("query_id", F.when(F.col("doc_id").isNull(), F.raise_error(F.lit("a decomposition step names an absent paragraph"))).otherwise(F.col("doc_id")).alias("doc_id"), F.struct(F.lit(0).alias("tier"), F.col("pos").alias("at")).alias("place"))
    context = para.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "doc_id"))), lambda x: x["doc_id"]).alias("context_doc_ids"))  # the paragraphs of one question
    marked = para.where("marked").select("query_id", "doc_id", F.struct(F.lit(1).alias("tier"), F.col("idx").alias("at")).alias("place"))
    questions = (
        numbered.select(
            F.col("id").alias("query_id"), "question", answer_list(F.col("answer")).alias("answers"),
            F.coalesce("answer_aliases", F.array().cast("array<string>")).alias("answer_aliases"), "question_decomposition", (F.col("answerable") if "answerable" in rows.columns else F.lit(None).cast("boolean")).alias("answerable"),
        )
        .join(context, "query_id", "left")
        .withColumn("metadata", F.to_json(F.struct(F.lit("musique").alias("dataset"), "answerable", "answer_aliases", "question_decomposition", "context_doc_ids"), {"ignoreNullFields": "false"}))
        .drop("answerable", "answer_aliases", "question_decomposition", "context_doc_ids")
        .join(_support(named.unionByName(marked)), "query_id", "left")
        .withColumn("supporting_doc_ids", F.coalesce("supporting_doc_ids", F.array().cast("array<string>")))
    )
    missing = numbered.select(F.col("id").alias("query_id"), F.lit(None).cast("string").alias("title")).limit(0)
    return Converted(documents, questions, conflicts, missing)


CONVERTERS = {"hotpotqa": convert_hotpotqa, "twowiki": convert_twowiki, "musique": convert_musique}


def convert_dataset(name: str, rows: DataFrame) -> Converted:
    if name not in CONVERTERS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(sorted(CONVERTERS))}")
    return CONVERTERS[name](rows)


def conversion_report(done: Converted) -> DataFrame:
    """One row: documents, questions, questions without support, conflicts, missing titles."""
    spark = done.documents.sparkSession
    counts = [
        done.documents.agg(F.count("*").alias("n_documents")),
        done.questions.agg(F.count("*").alias("n_questions"), F.count_if(F.size("supporting_doc_ids") == 0).alias("n_unsupported")),
        done.conflicts.agg(F.count("*").alias("n_conflicts")),
        done.missing.agg(F.count("*").alias("n_missing")),
    ]
    out = spark.range(1).select(F.lit(1).alias("_one"))
    for c in counts:  # five single-row tables side by side
        out = out.join(F.broadcast(c.withColumn("_one", F.lit(1))), "_one")
    return out.drop("_one")
