"""Undirected fact graph: edges, degrees, components, transition weights, personalised PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import broadcast_if_small, discard, materialize

#: Moves from one node that meet the walkers there in one task; a node with more is cut into parts.
PART = 1_000
#: Best nodes of a query whose passages bound what its k-th passage scores at least.
BOUND_NODES = 20


def fact_entity_edges(facts: DataFrame) -> DataFrame:
    """(fact_id, entity): each fact with the distinct records it mentions."""
    return facts.select("fact_id", F.explode(F.array_compact(F.array("subject_local", "object_local"))).alias("entity")).distinct()


def symmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(src, dst) in both directions, each once."""
    both = F.array(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")), F.struct(F.col(b).alias("src"), F.col(a).alias("dst")))
    return edges.select(F.explode(both).alias("e")).select("e.src", "e.dst").distinct()


def degree_report(edges: DataFrame) -> DataFrame:
    """Vertices by degree."""
    return edges.groupBy("src").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n_vertices"))


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component): smallest vertex linked to each, by hooking to the smallest neighbour and contracting."""
    live = materialize(edges.where("src <> dst").select("src", "dst"), "edges")
    maps = []
    while live.limit(1).count():
        hook = live.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("v"), F.least("src", "m").alias("p"))
        jump = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        parent = materialize(hook.join(jump, "p").select("v", F.col("pp").alias("p")), "parent")
        maps.append(parent)
        side = lambda c: parent.select(F.col("v").alias(c), F.col("p").alias(f"_{c}"))
        moved = materialize(live.join(side("src"), "src").join(side("dst"), "dst").where("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct(), "edges")
        discard(live)
        live = moved
    out = None
    for parent in reversed(maps):
        if out is None:
            out = parent.select("v", "p")
        else:
            up = out.select(F.col("v").alias("p"), F.col("p").alias("_up"))
            out = materialize(parent.join(up, "p", "left").select("v", F.coalesce("_up", "p").alias("p")), "labels")
    alone = edges.select(F.col("src").alias("vertex"))
    if out is None:
        return alone.distinct().select("vertex", F.col("vertex").alias("component"))
    rows = alone.distinct().join(out.select(F.col("v").alias("vertex"), F.col("p").alias("component")), "vertex", "left")
    return rows.select("vertex", F.coalesce("component", "vertex").alias("component"))


def transitions(edges: DataFrame) -> DataFrame:
    """(src, dst, p): each edge with its share of the weight that leaves ``src``; edges may carry ``weight``."""
    weighted = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    total = weighted.groupBy("src").agg(F.sum("weight").alias("_total")).where("_total > 0")
    return weighted.join(total, "src").select("src", "dst", (F.col("weight") / F.col("_total")).alias("p"))


def seed_vector(seeds: DataFrame, fact_weight: float = 0.8) -> DataFrame:
    """(query, node, p): restart probabilities from scored seeds (query, kind in fact/entity, node, score).

    Negative scores count as 0; each kind is normalised in itself (evenly if all its scores are 0)
    and the kinds are mixed by ``fact_weight``, or alone where the other is missing.
    """
    w = Window.partitionBy("query", "kind")
    s = seeds.withColumn("score", F.greatest("score", F.lit(0.0))).withColumn("_sum", F.sum("score").over(w)).withColumn("_n", F.count("*").over(w))
    s = s.withColumn("_p", F.when(F.col("_sum") > 0, F.col("score") / F.col("_sum")).otherwise(1 / F.col("_n")))
    q = Window.partitionBy("query")
    s = s.withColumn("_kinds", F.size(F.collect_set("kind").over(q)))
    share = F.when(F.col("_kinds") < 2, 1.0).when(F.col("kind") == "fact", min(1.0, max(0.0, fact_weight))).otherwise(1 - min(1.0, max(0.0, fact_weight)))
    mixed = s.groupBy("query", "node").agg(F.sum(F.col("_p") * share).alias("p"))
    return mixed.withColumn("p", F.col("p") / F.sum("p").over(q)).where("p > 0")


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.65, iterations: int = 10, tolerance: float | None = None) -> DataFrame:
    """(query, node, score): restarted walks of all queries at once.

    One iteration is a join on the source and an aggregation on (query, target), and is written, so
    each step is planned once. The mass of vertices without edges returns to the query's seeds. With ``tolerance`` a
    query whose scores moved no more than that in total keeps them and takes no further part.
    """
    moves = materialize(transitions(edges).select("src", "dst", "p"), "moves")
    sources = materialize(moves.select(F.col("src").alias("node")).distinct(), "sources")
    seeds = materialize(seeds.select("query", "node", "p"), "seeds")
    x = seeds.select("query", "node", F.col("p").alias("score"))
    done: list[DataFrame] = []
    for _ in range(iterations):
        flow = x.join(moves, x["node"] == moves["src"]).groupBy("query", F.col("dst").alias("node")).agg((F.sum(F.col("score") * F.col("p")) * alpha).alias("score"))
        lost = x.join(sources, "node", "left_anti").groupBy("query").agg(F.sum("score").alias("_lost"))
        open_ = seeds.join(x.select("query").distinct(), "query", "left_semi") if done else seeds
        back = open_.join(lost, "query", "left").select("query", "node", (F.col("p") * (1 - alpha + alpha * F.coalesce("_lost", F.lit(0.0)))).alias("score"))
        nxt = materialize(flow.unionByName(back).groupBy("query", "node").agg(F.sum("score").alias("score")), "rank")
        if tolerance is not None:
            change = nxt.select("query", F.col("score"), "node").unionByName(x.select("query", (-F.col("score")).alias("score"), "node")).groupBy("query", "node").agg(F.abs(F.sum("score")).alias("d"))
            moving = materialize(change.groupBy("query").agg(F.sum("d").alias("d")).where(F.col("d") > tolerance).select("query"), "moving")
            done.append(nxt.join(moving, "query", "left_anti"))
            nxt = nxt.join(moving, "query", "left_semi")
            if not moving.limit(1).count():
                break
        x = nxt
    else:
        done.append(x)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def rank_passages(scores: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """(query, passage, score, best_fact, rank): passages by their best fact; ``scores(query, node, score)``, ``facts(node, fact_id, passage)``."""
    best = scores.join(facts, "node").groupBy("query", "passage").agg(F.max(F.struct("score", F.col("fact_id"))).alias("_m"), F.min_by("fact_id", F.struct(-F.col("score"), F.col("fact_id"))).alias("best_fact"))
    w = Window.partitionBy("query").orderBy(F.col("_m.score").desc(), F.col("passage"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "passage", F.col("_m.score").alias("score"), "best_fact", "rank")


def fact_kinds(facts: DataFrame) -> DataFrame:
    """(kind, ends, n): the distinct sets of nodes that facts stand on, numbered, and how many facts have each; ``facts(fact, docs, ends)``, each fact once."""
    return facts.groupBy("ends").agg(F.count("*").alias("n")).withColumn("kind", F.monotonically_increasing_id())


def kind_moves(kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst, w, share) and (node, share): how much of what a fact of ``src`` holds comes to ``dst``, and the share of a node that each of its facts gets."""
    held = kinds.select(F.explode("ends").alias("src"), "ends", "n")
    shares = materialize(held.groupBy(F.col("src").alias("node")).agg((1.0 / F.sum("n")).alias("share")), "shares")
    moves = held.select("src", F.explode("ends").alias("dst"), (F.col("n") / F.size("ends")).alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return materialize(moves.join(shares.withColumnRenamed("node", "dst"), "dst").select("src", "dst", "w", "share"), "moves"), shares


def scores_per_fact(kinds: DataFrame, seeds: DataFrame, alpha: float, iterations: int) -> DataFrame:
    """(query, node, v): what each node gives to each of its facts in the last of ``iterations`` restarted steps from ``seeds(query, node, p)``.

    As ``personalised_pagerank`` over facts and their nodes with seeds on nodes. Nodes only meet facts there, so what facts
    hold after an even (odd) number of steps comes from what nodes hold after odd (even) ones: two steps at a time over nodes
    alone give it. A seed without facts gives its mass back to all seeds of the query each time. Products are taken
    in the order of single steps, so halves are rounded as there.
    """
    moves, shares = kind_moves(kinds)
    at = seeds.join(shares, "node", "left")
    lost = at.groupBy("query").agg(F.sum(F.when(F.col("share").isNull(), F.col("p")).otherwise(0.0)).alias("_lost"))
    seeds = materialize(at.where("share is not null").join(lost, "query").select("query", "node", "p", "share", "_lost"), "seeds")
    back, gone = [F.lit(1.0)], F.col("_lost")
    for _ in range(1, iterations):
        back.append(1 - alpha + alpha * gone)
        gone = F.col("_lost") * back[-1]
    first = (iterations - 1) % 2
    x = seeds.select("query", "node", (F.col("p") * back[first]).alias("x"), "share")
    given = alpha * F.col("x") * F.col("share")
    wide = materialize(moves.groupBy("src").agg(F.ceil(F.count("*") / PART).alias("_parts")).where("_parts > 1"), "wide")
    parts = broadcast_if_small(wide)
    cut = moves.join(parts, "src", "left").select("src", "dst", "w", "share", F.pmod("dst", F.coalesce("_parts", F.lit(1))).alias("_part"))
    for i in range(first + 2, iterations, 2):
        spread = x.join(parts.withColumnRenamed("src", "node"), "node", "left").select("query", F.col("node").alias("src"), given.alias("v"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part"))
        flow = spread.join(cut, ["src", "_part"]).select("query", F.col("dst").alias("node"), (alpha * F.col("v") * F.col("w")).alias("x"), "share")
        new = materialize(flow.unionByName(seeds.select("query", "node", (F.col("p") * back[i]).alias("x"), "share")).groupBy("query", "node").agg(F.sum("x").alias("x"), F.max("share").alias("share")), "rank")
        discard(x)
        x = new
    out = materialize(x.select("query", "node", given.alias("v")), "given")
    for df in (x, moves, shares, seeds, wide):
        discard(df)
    return out


def rank_fact_passages(scores: DataFrame, kinds: DataFrame, facts: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(query, passage, score, best_fact, rank): as ``rank_passages`` of facts that score the sum of ``scores(query, node, v)`` over their ends, rounded.

    Facts of one kind score the same, so of its passages the first k are enough. A fact among the best k passages has an end
    that gives its share of the k-th best at least; only facts of such ends are summed.
    """
    near = 2 * 10.0**-digits  # more than rounding moves a score
    # what is grouped, ranked and joined by kind is shuffled once
    named = facts.select("ends", "fact", F.explode("docs").alias("passage")).repartition("ends").groupBy("ends", "passage").agg(F.min("fact").alias("fact"))
    w = Window.partitionBy("ends").orderBy("passage")
    first = named.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    places = materialize(first.join(kinds.select("ends", "kind"), "ends").select("kind", "passage", "fact"), "places")
    ends = materialize(kinds.select("kind", F.explode("ends").alias("node")), "ends")
    of = ends.join(places.select("kind", "passage"), "kind").select("node", "passage").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("passage"))).where(F.col("_r") <= k).drop("_r")
    best = scores.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.col("v").desc(), "node"))).where(F.col("_r") <= BOUND_NODES)
    sure = best.join(of, "node").groupBy("query", "passage").agg(F.max("v").alias("v")).withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.col("v").desc())))
    bound = materialize(sure.where(F.col("_r") <= k).groupBy("query").agg(F.when(F.count("*") == k, F.min("v")).otherwise(0.0).alias("_least")), "bound")
    most = kinds.agg(F.max(F.size("ends"))).first()[0] or 1
    big = scores.join(broadcast_if_small(bound), "query").where(F.col("v") >= (F.col("_least") - near) / most)
    asked = big.join(ends, "node").select("query", "kind").distinct().join(ends, "kind")
    summed = materialize(asked.join(scores, ["query", "node"]).groupBy("query", "kind").agg(F.round(F.sum("v"), digits).alias("score")), "summed")
    out = summed.join(places, "kind").groupBy("query", "passage").agg(F.max("score").alias("score"), F.min_by("fact", F.struct(-F.col("score"), F.col("fact"))).alias("best_fact"))
    q = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("passage"))
    return out.withColumn("rank", F.row_number().over(q)).where(F.col("rank") <= k).select("query", "passage", "score", "best_fact", "rank")
