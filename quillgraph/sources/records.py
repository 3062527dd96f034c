"""Record sources: corpora and question sets from JSON lines, JSON arrays or parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


class BadRecord(ValueError):
    """A record that breaks the format, with its line number."""


def read_jsonl(spark: SparkSession, path: str, torn: bool = False) -> DataFrame:
    """(line_no, value VARIANT) of each non-blank line; a line that is no JSON object raises BadRecord.

    With ``torn`` a last line that was cut off while it was written is left out; the file is one that is appended to.

    The line number comes from the position inside the file, so a bad record of a single file can be
    named; the check is one distributed pass over the text.
    """
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()).where(F.trim("value") != "")
    parsed = lines.select("_at", "value", F.try_parse_json("value").alias("json"))
    if torn:
        last = parsed.agg(F.max_by(F.struct("_at", F.col("json").isNull().alias("cut")), "_at").alias("l")).first()["l"]
        if last is not None and last["cut"]:
            parsed = parsed.where(F.col("_at") < last["_at"])
    bad = parsed.where(F.col("json").isNull() | ~F.trim("value").startswith("{")).orderBy("_at").limit(1).collect()
    if bad:
        above = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()).where(F.col("_at") <= bad[0]["_at"]).count()
        raise BadRecord(f"{path}: line {above} is no JSON object: {bad[0]['value'][:80]}")
    return parsed.select(F.col("_at").alias("line_no"), F.col("json").alias("value"))


def read_any_json(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_jsonl``, also for a file that is one JSON array."""
    first = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim(F.regexp_replace("value", r"^\s+", "")), 1, 1).alias("c")).limit(1).collect()
    if first and first[0]["c"] == "[":
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<variant>")).alias("value"))
        return rows.select(F.monotonically_increasing_id().alias("line_no"), "value")
    return read_jsonl(spark, path)


def as_list(value: Column, path: str) -> Column:
    """A list field: null becomes empty, a scalar a list of itself, elements become strings; an object is an error."""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    many = F.try_variant_get(value, path, "array<string>")
    one = F.try_variant_get(value, path, "string")
    none = F.array().cast("array<string>")
    wrong = F.raise_error(F.concat(F.lit(f"{path} is no list: "), kind)).cast("array<string>")
    return F.when(kind.isNull() | (kind == "VOID"), none).when(kind.startswith("OBJECT"), wrong).when(many.isNotNull(), many).when(one.isNotNull(), F.array(one)).otherwise(none)


def _required(c: Column, name: str) -> Column:
    return F.when(c.isNull() | (F.trim(c) == ""), F.raise_error(F.lit(f"record without {name}"))).otherwise(c)


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, text, metadata): doc_id and text are required, title defaults to empty."""
    v = F.col("value")
    text = lambda p: F.try_variant_get(v, p, "string")
    rows = read_jsonl(spark, path)
    return rows.select(
        _required(text("$.doc_id"), "doc_id").alias("doc_id"),
        F.coalesce(text("$.title"), F.lit("")).alias("title"),
        _required(text("$.text"), "text").alias("text"),
        F.coalesce(F.to_json(F.try_variant_get(v, "$.metadata", "variant")), F.lit("{}")).alias("metadata"),
    )


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, question, answers, supporting_doc_ids, supporting_facts, metadata) with coerced lists."""
    v = F.col("value")
    text = lambda p: F.try_variant_get(v, p, "string")
    return read_any_json(spark, path).select(
        _required(text("$.query_id"), "query_id").alias("query_id"),
        _required(text("$.question"), "question").alias("question"),
        as_list(v, "$.answers").alias("answers"),
        as_list(v, "$.supporting_doc_ids").alias("supporting_doc_ids"),
        as_list(v, "$.supporting_facts").alias("supporting_facts"),
        F.coalesce(F.to_json(F.try_variant_get(v, "$.metadata", "variant")), F.lit("{}")).alias("metadata"),
    )


def load_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table; a missing one is empty with the given schema."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def toy_corpus(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A tiny corpus with two questions, for smoke runs."""
    docs = spark.createDataFrame(
        [
            ("d1", "Marlow Bridge", "Marlow Bridge was built by Ada Finch in 1832."),
            ("d2", "Ada Finch", "Ada Finch was born in Torvale."),
            ("d3", "Torvale", "Torvale lies on the river Senn."),
            ("d4", "Senn", "The Senn flows into the northern sea."),
            ("d5", "Copper Fair", "The Copper Fair is held in Torvale every spring."),
        ],
        "doc_id string, title string, text string",
    )
    questions = spark.createDataFrame(
        [("q1", "Where was the builder of Marlow Bridge born?", ["Torvale"], ["d1", "d2"]), ("q2", "On which river does the town of the Copper Fair lie?", ["Senn"], ["d5", "d3"])],
        "query_id string, question string, answers array<string>, supporting_doc_ids array<string>",
    )
    return docs, questions
