"""Short-answer scores and the evaluation table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import answer_tokens

_CLOSED = ("yes", "no", "noanswer")


def exact_match(prediction: Column, answers: Column) -> Column:
    """1.0 if the normalised prediction equals a normalised answer, else 0.0."""
    p = F.array_join(answer_tokens(prediction), " ")
    return F.coalesce(F.array_max(F.transform(F.filter(answers, lambda a: a.isNotNull()), lambda a: F.when(F.array_join(answer_tokens(a), " ") == p, 1.0).otherwise(0.0))), F.lit(0.0))


def _common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    count = lambda arr, t: F.size(F.filter(arr, lambda x: x == t))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(count(a, t), count(b, t)))


def _f1(p: Column, g: Column) -> Column:
    np_, ng, common = F.size(p), F.size(g), _common(p, g)
    pj, gj = F.array_join(p, " "), F.array_join(g, " ")
    closed = (pj.isin(*_CLOSED) | gj.isin(*_CLOSED)) & (pj != gj)
    overlap = F.when(common == 0, 0.0).otherwise(2.0 * common / (np_ + ng))
    return F.when(closed, 0.0).when((np_ == 0) & (ng == 0), 1.0).when((np_ == 0) | (ng == 0), 0.0).otherwise(overlap)


def token_f1(prediction: Column, answers: Column) -> Column:
    """Best token F1 over the answers; yes, no and noanswer count only on full equality."""
    p = answer_tokens(prediction)
    return F.coalesce(F.array_max(F.transform(F.filter(answers, lambda a: a.isNotNull()), lambda a: _f1(p, answer_tokens(a)))), F.lit(0.0))


def answer_report(rows: DataFrame) -> DataFrame:
    """Means of exact match and F1 over (prediction, answers) with at least one answer; unknown predictions counted."""
    scored = rows.where(F.size("answers") > 0).select(F.coalesce("prediction", F.lit("")).alias("prediction"), "answers")
    scored = scored.select("prediction", exact_match(F.col("prediction"), F.col("answers")).alias("em"), token_f1(F.col("prediction"), F.col("answers")).alias("f1"))
    return scored.agg(F.count("*").alias("n"), F.avg("em").alias("exact_match"), F.avg("f1").alias("token_f1"), F.count_if(F.lower("prediction").isin("", "unknown")).alias("n_unknown"))


def evidence_report(selected: DataFrame, results: DataFrame, gold: DataFrame) -> DataFrame:
    """Means over all selected questions: an unfinished one counts 0, recall is null without gold.

    ``selected(query)``, ``results(query, doc)``, ``gold(query, doc)``.
    """
    g = gold.where("doc is not null").distinct()
    found = g.join(results.select("query", "doc").distinct().withColumn("_hit", F.lit(1)), ["query", "doc"], "left").groupBy("query").agg(F.count("*").alias("_gold"), F.count("_hit").alias("_found"))
    done = results.select("query").distinct().withColumn("_done", F.lit(True))
    rows = selected.select("query").distinct().join(found, "query", "left").join(done, "query", "left")
    return rows.agg(
        F.count("*").alias("n_selected"),
        F.count("_done").alias("n_finished"),
        F.avg(F.col("_found") / F.col("_gold")).alias("recall"),
        F.avg(F.coalesce((F.col("_found") == F.col("_gold")).cast("double"), F.lit(0.0))).alias("complete_evidence"),
    )
