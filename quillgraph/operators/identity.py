"""Identity resolution: candidates, review, greedy complete-link merge, canonical entities."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import norm, stable_id
from quillgraph.functions.vectors import inner
from quillgraph.operators.graph import components, symmetric
from quillgraph.operators.retrieval import top_k

#: Nearest records of a record that become its candidates.
CANDIDATE_K = 12


def type_group(type_: Column) -> Column:
    return F.when(type_.isin("Other", "Unknown") | type_.isNull(), "OTHER").otherwise(type_)


def compatible(a: Column, b: Column, explicit: bool) -> Column:
    """Whether two types can name one referent: equal, or unknown against anything where that is allowed."""
    ga, gb = type_group(a), type_group(b)
    same = ga == gb
    return same | (ga == "OTHER") | (gb == "OTHER") if explicit else same


def exact_name_candidates(records: DataFrame) -> DataFrame:
    """(left, right, name_key): the first record of each normalised name against each other one of its type group."""
    keyed = records.select("local_id", type_group(F.col("type")).alias("grp"), norm(F.col("name")).alias("name_key")).where("local_id is not null and name_key <> ''").distinct()
    first = keyed.groupBy("grp", "name_key").agg(F.min("local_id").alias("left"))
    return keyed.join(first, ["grp", "name_key"]).where("local_id <> left").select("left", F.col("local_id").alias("right"), "grp", "name_key")


def score_candidates(candidates: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Candidates whose vectors (local_id, v) have inner product at least ``threshold``."""
    side = lambda c, v: vectors.select(F.col("local_id").alias(c), F.col("v").alias(v))
    scored = candidates.join(side("left", "_vl"), "left").join(side("right", "_vr"), "right").withColumn("score", inner(F.col("_vl"), F.col("_vr")))
    return scored.drop("_vl", "_vr").where(F.col("score") >= threshold)


def nearest_name_candidates(records: DataFrame, vectors: DataFrame, threshold: float, k: int = CANDIDATE_K) -> DataFrame:
    """(left, right, score): each record with its ``k`` nearest of the same normalised name and type group, from ``threshold`` on.

    Records of other names take no place among the k, so whatever equal-name pair is among the k
    nearest of the whole type group is here too.
    """
    keyed = records.select("local_id", type_group(F.col("type")).alias("grp"), norm(F.col("name")).alias("name_key")).where("local_id is not null and name_key <> ''").distinct()
    usable = keyed.join(vectors.select("local_id"), "local_id", "left_semi")
    several = usable.groupBy("grp", "name_key").agg(F.count("*").alias("n")).where("n > 1")
    rows = usable.join(several, ["grp", "name_key"], "left_semi").join(vectors.select("local_id", "v"), "local_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("local_id")
        ids, m = pdf["local_id"].to_numpy(), np.array(pdf["v"].tolist(), dtype=float)
        found = []
        for start in range(0, len(ids), 1024):
            s = np.round(m[start : start + 1024] @ m.T, 12)
            here = np.arange(len(s))
            s[here, start + here] = -np.inf
            near = np.argsort(-s, axis=1, kind="stable")[:, :k]
            score = np.take_along_axis(s, near, axis=1)
            i, j = np.nonzero(score >= threshold)
            a, b = start + i, near[i, j]
            found.append(pd.DataFrame({"left": ids[np.minimum(a, b)], "right": ids[np.maximum(a, b)], "score": score[i, j]}))
        return pd.concat(found).drop_duplicates(["left", "right"])

    return rows.groupBy("grp", "name_key").applyInPandas(run, "left string, right string, score double").groupBy("left", "right").agg(F.max("score").alias("score"))


def nearest_candidates(asked: DataFrame, records: DataFrame, vectors: DataFrame, threshold: float, k: int = CANDIDATE_K) -> DataFrame:
    """(left, right, score, route): the nearest records of each asked one (local_id), within its type group and across the boundary of unknown types.

    ``asked`` is a stated set; ``records(local_id, type)``, unit ``vectors(local_id, v)``. Routes: ``type`` for the k nearest
    of the type group, ``boundary`` for the k nearest known records of an unknown one and the reverse. Ranks come first, then
    the threshold. A pair found by both sides or routes is one row with the smaller route.
    """
    typed = records.where("local_id is not null").groupBy("local_id").agg(F.min("type").alias("type")).select("local_id", type_group(F.col("type")).alias("grp"))
    base = typed.join(vectors.select("local_id", "v"), "local_id").select(F.col("local_id").alias("id"), "v", "grp")
    queries = base.join(asked.select(F.col("local_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("query"), F.col("v").alias("qv"), "grp")
    same = top_k(queries, base, k + 1, allowed=_same_group).where("query <> id")
    same = same.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where(F.col("rank") <= k)
    across = top_k(queries, base, k, allowed=_across_boundary)
    found = same.select("query", "id", "score", F.lit("type").alias("route")).unionByName(across.select("query", "id", "score", F.lit("boundary").alias("route"))).where(F.col("score") >= threshold)
    return found.groupBy(F.least("query", "id").alias("left"), F.greatest("query", "id").alias("right")).agg(F.max("score").alias("score"), F.max("route").alias("route"))


def _same_group(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, None] == b[None, :]


def _across_boundary(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == "OTHER")[:, None] != (b == "OTHER")[None, :]


def review_filter(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Marks why a candidate needs no review: equal names, incompatible types or one article."""
    side = lambda c: records.groupBy("local_id").agg(F.min("doc_id").alias(f"{c}_doc"), F.min("name").alias(f"{c}_name"), F.min("type").alias(f"{c}_type")).withColumnRenamed("local_id", c)
    both = candidates.join(side("left"), "left").join(side("right"), "right")
    reason = (
        F.when(norm(F.col("left_name")) == norm(F.col("right_name")), "equal_name")
        .when(~compatible(F.col("left_type"), F.col("right_type"), True), "type_conflict")
        .when(F.coalesce(F.col("left_doc") == F.col("right_doc"), F.lit(False)), "same_document")
        .otherwise("review")
    )
    return both.withColumn("reason", reason)


def greedy_merge(scored: DataFrame, threshold: float, conflict: Callable[[str, str], bool] | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(local_id, cluster): complete-link merge of candidates (left, right, score) in descending score.

    A merge depends only on candidates that touch the same clusters, so the components of the
    candidate graph are merged independently. ``conflict`` may forbid two records in one cluster; by
    default records of one article (the text before ``#``) never meet. With ``vectors`` (local_id, v)
    the members of two clusters are compared by their vectors; without, only by known candidates.
    """
    edges = symmetric(scored, "left", "right")
    comp = components(edges)
    rows = scored.join(comp.select(F.col("vertex").alias("left"), "component"), "left").select("component", "left", "right", "score")
    forbid = conflict or (lambda a, b: a.split("#")[0] == b.split("#")[0])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["left", "right"]).sort_values(["score", "left", "right"], ascending=[False, True, True], kind="stable")
        known = {(a, b): s for a, b, s in zip(pdf["left"], pdf["right"], pdf["score"])}
        known |= {(b, a): s for (a, b), s in known.items()}
        cluster = {x: x for x in pd.unique(pdf[["left", "right"]].to_numpy().ravel())}
        members = {x: [x] for x in cluster}
        for a, b in zip(pdf["left"], pdf["right"]):
            ca, cb = cluster[a], cluster[b]
            if ca == cb:
                continue
            # complete link: each pair across the two clusters must itself be a candidate
            if all(known.get((x, y), -1.0) >= threshold and not forbid(x, y) for x in members[ca] for y in members[cb]):
                keep, gone = sorted((ca, cb))
                for x in members[gone]:
                    cluster[x] = keep
                members[keep] += members.pop(gone)
        return pd.DataFrame({"local_id": list(cluster), "cluster": list(cluster.values())})

    if vectors is None:
        return rows.groupBy("component").applyInPandas(run, "local_id string, cluster string")

    def compare(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["left", "right"]).sort_values(["score", "left", "right"], ascending=[False, True, True], kind="stable")
        cluster = {x: x for x in pd.unique(pdf[["left", "right"]].to_numpy().ravel())}
        members = {x: [x] for x in cluster}
        matrix = {x: np.array([v], dtype=float) for x, v in zip(known["local_id"], known["v"])}
        articles = {x: {x.split("#")[0]} for x in cluster}
        for a, b in zip(pdf["left"], pdf["right"]):
            ca, cb = cluster[a], cluster[b]
            if ca == cb:
                continue
            if conflict is None:
                apart = not articles[ca].isdisjoint(articles[cb])
            else:
                apart = any(conflict(x, y) for x in members[ca] for y in members[cb])
            # complete link over the members' vectors, each distinct vector once
            if apart or np.round(matrix[ca] @ matrix[cb].T, 12).min() < threshold:
                continue
            keep, gone = sorted((ca, cb))
            for x in members[gone]:
                cluster[x] = keep
            members[keep] += members.pop(gone)
            articles[keep] |= articles.pop(gone)
            matrix[keep] = np.unique(np.concatenate([matrix[keep], matrix.pop(gone)]), axis=0)
        return pd.DataFrame({"local_id": list(cluster), "cluster": list(cluster.values())})

    own = comp.select(F.col("vertex").alias("local_id"), F.col("component").alias("own")).join(vectors.select("local_id", "v"), "local_id")
    return rows.groupBy("component").cogroup(own.groupBy("own")).applyInPandas(compare, "local_id string, cluster string")


def explicit_mapping(identities: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(local_id, entity_id): records joined by explicit links, directly or through others.

    With ``records`` (local_id, type) a link between records of two different known types joins nothing; a record
    of unknown type fits any.
    """
    pairs = identities.where("left_local is not null and right_local is not null")
    if records is not None:
        kind = records.where("local_id is not null").groupBy("local_id").agg(F.min("type").alias("type"))
        side = lambda c: kind.select(F.col("local_id").alias(f"{c}_local"), F.col("type").alias(f"{c}_type"))
        typed = pairs.select("left_local", "right_local").join(side("left"), "left_local", "left").join(side("right"), "right_local", "left")
        pairs = typed.where(compatible(F.col("left_type"), F.col("right_type"), True))
    comp = components(symmetric(pairs, "left_local", "right_local"))
    return comp.select(F.col("vertex").alias("local_id"), stable_id("E_", 20, root=F.col("component")).alias("entity_id"))


def canonical_entities(mapping: DataFrame, records: DataFrame) -> DataFrame:
    """(entity_id, name, n_members, n_names): canonical entities with their smallest name."""
    named = mapping.join(records.select("local_id", "name").distinct(), "local_id")
    return named.groupBy("entity_id").agg(F.min("name").alias("name"), F.countDistinct("local_id").alias("n_members"), F.countDistinct("name").alias("n_names"))
