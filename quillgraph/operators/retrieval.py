"""Exact vector search, passage ranking, relation priorities and retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.vectors import inner
from quillgraph.session import broadcast_if_small


#: Stated queries held by a task at once; more of them are searched block by block.
QUERY_BLOCK = 8_192


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length ``dim`` as a matrix, and their positions."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
    return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim), at


def query_blocks(queries: DataFrame, columns: list[str]) -> Iterator[pa.Table]:
    """The stated query set in blocks of about QUERY_BLOCK rows; one block at a time is on the driver."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for b in range(blocks):
        part = queries.select(*columns)
        yield (part if blocks == 1 else part.where(F.pmod(F.xxhash64(columns[0]), F.lit(blocks)) == b)).toArrow()


def top_k(queries: DataFrame, base: DataFrame, k: int, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(query, id, score, rank): exact inner-product search of a stated query set against all rows.

    Blocks of the query set ``queries(query, qv)`` are multiplied with the Arrow batches of ``base(id, v)``; each batch
    keeps its k best a query, and the rank filter is pushed below the shuffle, so at most k rows a query leave each
    task. Scores are rounded to nine digits and ties go to the smaller id. ``allowed`` gets the columns ``grp`` of
    both sides and tells which pairs may meet. Vectors of other lengths than the query's meet none.
    """
    grouped = ["grp"] if allowed else []
    schema = f"query {queries.schema['query'].dataType.simpleString()}, id {base.schema['id'].dataType.simpleString()}, score double"
    out = None
    for block in query_blocks(queries, ["query", "qv", *grouped]):
        lengths = np.unique(block.column("qv").combine_chunks().value_lengths().drop_null().to_numpy(zero_copy_only=False)) if block.num_rows else []
        sides = []
        for dim in lengths:
            q, at = _matrix(block.column("qv"), int(dim))
            sides.append((int(dim), q, block.column("query").take(pa.array(at)), np.array(block.column("grp").take(pa.array(at)).to_pylist(), dtype=object) if allowed else None))

        def run(batches: Iterator[pa.RecordBatch], sides: list = sides) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, q, names, groups in sides:
                    v, at = _matrix(batch.column("v"), dim)
                    if not len(v):
                        continue
                    ids = batch.column("id").take(pa.array(at))
                    order = np.argsort(np.array(ids.to_pylist(), dtype=object), kind="stable")  # ties then go to the smaller id
                    scores = np.round(q @ v[order].T, 9)
                    if allowed:
                        scores[~allowed(groups, np.array(batch.column("grp").take(pa.array(at)).to_pylist(), dtype=object)[order])] = -np.inf
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    value = np.take_along_axis(scores, best, axis=1)
                    row, col = np.nonzero(np.isfinite(value))
                    yield pa.RecordBatch.from_arrays([names.combine_chunks().take(pa.array(row)) if isinstance(names, pa.ChunkedArray) else names.take(pa.array(row)), ids.take(pa.array(order[best[row, col]])), pa.array(value[row, col])], names=["query", "id", "score"])

        found = base.select("id", "v", *grouped).where("id is not null").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def above(ranked: DataFrame, threshold: float) -> DataFrame:
    """Ranks first, filter after: a weak k-th result is dropped, not replaced."""
    return ranked.where(F.col("score") >= threshold)


def passages(ranked: DataFrame, owner: DataFrame, k: int) -> DataFrame:
    """(query, passage, score, best_fact, rank): each passage by its best candidate fact."""
    best = ranked.join(owner.select("id", "passage"), "id").groupBy("query", "passage").agg(F.max("score").alias("score"), F.min_by("id", F.struct(-F.col("score"), F.col("rank"))).alias("best_fact"))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("passage"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def relation_priority(relations: DataFrame, hints: DataFrame, threshold: float) -> DataFrame:
    """(relation, score, selected): best similarity of each relation (relation, v) to any hint (hint, qv), by block products."""
    schema = f"relation {relations.schema['relation'].dataType.simpleString()}, score double"
    out = None
    for block in query_blocks(hints, ["hint", "qv"]):

        def run(batches: Iterator[pa.RecordBatch], block: pa.Table = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = batch.column("v").value_lengths().drop_null().to_numpy(zero_copy_only=False)
                for dim in np.unique(lengths):
                    v, at = _matrix(batch.column("v"), int(dim))
                    q, _ = _matrix(block.column("qv"), int(dim))
                    if len(q):
                        yield pa.RecordBatch.from_arrays([batch.column("relation").take(pa.array(at)), pa.array(np.round((v @ q.T).max(axis=1), 9))], names=["relation", "score"])

        found = relations.select("relation", "v").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("relation").agg(F.max("score").alias("score")).withColumn("selected", F.col("score") >= threshold)


def similarity_edges(vectors: DataFrame, threshold: float, chunk: int = 256) -> DataFrame:
    """(a, b, score): pairs of one type with inner product at least ``threshold``, a before b.

    All pairs of a type are compared, as the definition asks; a type is cut into blocks of about
    ``chunk`` rows by hash, and block pairs spread over tasks, so a hot type is no hot task.
    """
    size = vectors.groupBy("type").agg(F.ceil(F.count("*") / chunk).cast("int").alias("_n"))
    v = vectors.join(broadcast_if_small(size), "type").withColumn("_b", F.pmod(F.hash("id"), F.col("_n")))
    left = v.select("type", F.col("id").alias("a"), F.col("v").alias("va"), F.col("_b").alias("x"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("y"))
    right = v.select("type", F.col("id").alias("b"), F.col("v").alias("vb"), F.col("_b").alias("y"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("x"))
    scored = left.join(right, ["type", "x", "y"]).where("a < b").select("type", "a", "b", inner(F.col("va"), F.col("vb")).alias("score"))
    return scored.where(F.col("score") >= threshold)


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, recall, hit, mrr, n): means over the queries with gold; a query without result scores 0.

    ``ranked(query, doc, rank)``, ``gold(query, doc)``.
    """
    gold = gold.where("doc is not null").distinct()
    hits = gold.join(ranked.select("query", "doc", "rank"), ["query", "doc"], "left")
    cuts = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    per = (
        hits.select("query", "doc", "rank", cuts)
        .groupBy("query", "k")
        .agg(F.countDistinct("doc").alias("_gold"), F.countDistinct(F.when(F.col("rank") <= F.col("k"), F.col("doc"))).alias("_found"), F.min(F.when(F.col("rank") <= F.col("k"), F.col("rank"))).alias("_first"))
    )
    return per.groupBy("k").agg(
        F.avg(F.col("_found") / F.col("_gold")).alias("recall"),
        F.avg((F.col("_found") > 0).cast("double")).alias("hit"),
        F.avg(F.coalesce(1 / F.col("_first"), F.lit(0.0))).alias("mrr"),
        F.avg((F.col("_found") == F.col("_gold")).cast("double")).alias("complete"),
        F.count("*").alias("n"),
    )
