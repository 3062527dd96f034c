"""Budgeted evidence search for all questions at once.

A question starts at the records it mentions. In each round its particles are shared between its
frontiers in lots, walk a few steps along directed views, and the new chains are judged by a
checker. Judged chains are archived, their ends become new frontiers, and frontiers that were only
blocked relax towards other relations. All questions advance together: a round is a handful of
joins and windows keyed by question, and the state between rounds is a written table.

Random draws are hash-derived (``walks.uniform``), so a retried task repeats them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import norm
from quillgraph.operators.walks import uniform
from quillgraph.session import discard, materialize

#: Judges chains: for each (question, labels, facts) whether the chain is useful.
Checker = Callable[[Sequence[tuple[str, list[str], list[str]]]], Sequence[bool]]


@dataclass(frozen=True)
class Budget:
    particles: int = 100
    lot: int = 10
    steps: int = 2
    rounds: int = 4
    first_ranks: int = 3
    epsilon_step: float = 0.1
    epsilon_most: float = 0.3
    check: int = 20
    documents: int = 5
    seed: int = 0


FRONTIER = "query string, fid string, mention string, node string, prefix array<string>, labels array<string>, docs array<string>, base double, rank int, epsilon double, processed bigint, walked bigint, blocked bigint"


def start_frontiers(candidates: DataFrame) -> DataFrame:
    """Frontiers of (query, mention, node, prior, rank)."""
    empty = F.array().cast("array<string>")
    return candidates.select(
        "query", F.sha2(F.concat_ws("|", "query", "mention", "node"), 256).alias("fid"), "mention", "node", empty.alias("prefix"), empty.alias("labels"), empty.alias("docs"),
        F.col("prior").cast("double").alias("base"), F.col("rank").cast("int").alias("rank"), F.lit(0.0).alias("epsilon"), *[F.lit(0).cast("bigint").alias(c) for c in ("processed", "walked", "blocked")],
    )


def eligible(frontiers: DataFrame, round_: int, budget: Budget) -> DataFrame:
    rows = frontiers.where(F.size("prefix") < budget.steps * budget.rounds)
    return rows if round_ > 1 else rows.where(F.col("rank") <= budget.first_ranks)


def allocate(frontiers: DataFrame, round_: int, budget: Budget) -> DataFrame:
    """Frontiers with ``lots``: fresh continuations get one each first, the rest is drawn by weight."""
    lots = max(1, budget.particles // budget.lot)
    first = max(1, lots // 2)
    order = Window.partitionBy("query").orderBy(F.col("_fresh").desc(), F.sha2(F.concat_ws("|", F.lit(budget.seed), F.lit(round_), "fid"), 256))
    rows = frontiers.withColumn("_fresh", (F.size("prefix") > 0) & (F.col("walked") == 0)).withColumn("_place", F.row_number().over(order))
    rows = rows.withColumn("_sure", (F.col("_fresh") & (F.col("_place") <= first)).cast("int"))
    rows = rows.withColumn("_w", F.col("base") * budget.lot / (budget.lot + F.col("processed")))
    run = Window.partitionBy("query").orderBy("fid")
    rows = rows.withColumn("_hi", F.sum("_w").over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_w").over(Window.partitionBy("query"))).withColumn("_given", F.sum("_sure").over(Window.partitionBy("query")))
    # every frontier looks at the draws of its question, so nothing is joined
    draws = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.lit(lots) - F.col("_given"))), lambda i: uniform(F.lit(budget.seed), F.lit(round_), F.col("query"), i) * F.col("_all"))
    drawn = F.size(F.filter(draws, lambda u: (u < F.col("_hi")) & (u >= F.col("_hi") - F.col("_w"))))
    out = rows.withColumn("lots", (F.col("_sure") + drawn).cast("int"))
    return out.where("lots > 0").drop("_fresh", "_place", "_sure", "_w", "_hi", "_all", "_given")


def edge_intervals(steps: DataFrame) -> DataFrame:
    """Per node its edges of each kind (priority or not), numbered from 0, and how many it has of each."""
    steps = steps.repartition("from_node")  # both windows and the counts come of one shuffle
    w = Window.partitionBy("from_node", "priority")
    place = F.row_number().over(w.orderBy("fact_id", "direction", F.coalesce("to_node", F.lit(""))))
    both = Window.partitionBy("from_node")
    return steps.select(
        F.col("from_node").alias("node"), "priority", (place - 1).cast("bigint").alias("_place"), F.col("fact_id").alias("_fact"), F.col("to_node").alias("_to"), F.col("label").alias("_label"), F.col("doc_id").alias("_doc"),
        F.count_if(F.col("priority")).over(both).alias("_some"), F.count_if(~F.col("priority")).over(both).alias("_other"),
    )


def walk(allocated: DataFrame, intervals: DataFrame, round_: int, budget: Budget) -> DataFrame:
    """One row per particle: the frontier, the new path and whether it moved; see ``walk_together``."""
    together = walk_together(allocated, intervals, round_, budget)
    return together.select("*", F.explode("ps").alias("p")).drop("ps")


def walk_together(allocated: DataFrame, intervals: DataFrame, round_: int, budget: Budget) -> DataFrame:
    """One row for all particles ``ps`` of a frontier that took the same path: the frontier, the new path and whether they moved.

    A step first decides between asked-for and other edges (1 - epsilon to epsilon), then draws
    evenly within the kind. Edges of used facts have no weight and the rest is normalised again: the
    used edges at the particles' node are looked up, what they leave of each kind decides the kind, and the draw skips their
    numbers. A particle without a usable edge rests. The number of the drawn edge is in the join key, so particles at a hub
    meet one edge, and the lookup of used edges is by node and fact. Each particle draws on its own, but those at one place
    travel as one row, and only with what the next step needs; the frontier's own columns join them at the end.
    """
    kinds = intervals.select("node", "_some", "_other").distinct()
    empty = F.array().cast("array<string>")
    state = allocated.select("fid", "epsilon", F.size("prefix").alias("_from"), "node", F.col("prefix").alias("path"), empty.alias("labels"), empty.alias("docs"), F.sequence(F.lit(1), F.col("lots") * budget.lot).alias("ps"), F.lit(1).alias("_first"))
    id_ = ["fid", "_first"]
    for depth in range(budget.steps):
        u = lambda p, name: uniform(F.lit(budget.seed), F.lit(round_), F.col("fid"), p, F.lit(depth), F.lit(name))  # noqa: E731, B023
        known = intervals.select("node", F.col("_fact").alias("_f"), F.col("priority").alias("_kind"), "_place")
        gone = state.where("node is not null").select(*id_, "node", F.explode(F.array_distinct("path")).alias("_f")).join(known, ["node", "_f"])
        gone = gone.groupBy(*id_).agg(*[F.array_sort(F.collect_list(F.when(F.col("_kind") == k, F.col("_place")))).alias(c) for k, c in ((True, "_us"), (False, "_uo"))])  # as many as the path has facts
        none = F.array().cast("array<bigint>")
        drawn = state.join(kinds, "node", "left").join(gone, id_, "left").withColumn("_us", F.coalesce("_us", none)).withColumn("_uo", F.coalesce("_uo", none))
        both = (F.col("_some") > 0) & (F.col("_other") > 0)
        left_s, left_o = F.col("_some") - F.size("_us"), F.col("_other") - F.size("_uo")
        mass_s = F.when(both, (1 - F.col("epsilon")) * left_s / F.col("_some")).when(F.col("_some") > 0, left_s / F.col("_some")).otherwise(0.0)
        mass_o = F.when(both, F.col("epsilon") * left_o / F.col("_other")).when((F.col("_other") > 0) & (F.col("epsilon") > 0), left_o / F.col("_other")).otherwise(0.0)
        resting = F.size("path") > F.col("_from") + depth
        drawn = drawn.withColumn("_ms", mass_s).withColumn("_mo", mass_o).withColumn("_ls", left_s).withColumn("_lo", left_o)
        drawn = drawn.withColumn("_rests", resting | (F.col("_ms") + F.col("_mo") <= 0) | F.col("_some").isNull())
        asked = lambda p: F.when(F.col("_rests"), None).otherwise((F.col("_mo") <= 0) | (u(p, "kind") * (F.col("_ms") + F.col("_mo")) < F.col("_ms")))  # noqa: E731, B023
        drawn = drawn.withColumn("_each", F.transform("ps", lambda p: F.struct(p.alias("p"), asked(p).alias("asked"))))  # noqa: B023

        def place(d):
            n = F.when(d["asked"], F.col("_ls")).otherwise(F.col("_lo"))
            first = F.least(F.floor(u(d["p"], "edge") * n), n - 1).cast("bigint")  # noqa: B023
            return F.when(d["asked"].isNotNull(), F.aggregate(F.when(d["asked"], F.col("_us")).otherwise(F.col("_uo")), first, lambda at, used: F.when(used <= at, at + 1).otherwise(at)))

        drawn = drawn.withColumn("_each", F.transform("_each", lambda d: F.struct(d["p"].alias("p"), F.struct(d["asked"].alias("asked"), place(d).alias("place")).alias("edge"))))  # noqa: B023
        drawn = drawn.select("fid", "epsilon", "_from", "node", "path", "labels", "docs", "_each", F.explode(F.array_distinct(F.col("_each.edge"))).alias("_edge"))
        drawn = drawn.withColumn("ps", F.transform(F.filter("_each", lambda d: d["edge"].eqNullSafe(F.col("_edge"))), lambda d: d["p"])).drop("_each")
        edges = intervals.select(F.col("node").alias("_node"), F.col("priority").alias("_kind"), "_place", "_fact", "_to", "_label", "_doc")
        # particles without a draw keep their row: the null kind meets no edge
        drawn_at = (F.col("node") == F.col("_node")) & (F.col("_edge.asked") == F.col("_kind")) & (F.col("_edge.place") == F.col("_place"))
        hit = drawn.join(edges, drawn_at, "left")
        fresh = F.col("_fact").isNotNull()
        more = lambda c, v: F.when(fresh, F.array_append(c, v)).otherwise(F.col(c)).alias(c)  # noqa: E731, B023
        state = hit.select("fid", "epsilon", "_from", F.when(fresh, F.col("_to")).otherwise(F.col("node")).alias("node"), more("path", F.col("_fact")), more("labels", F.col("_label")), more("docs", F.col("_doc")), "ps", F.get("ps", F.lit(0)).alias("_first"))
    own = allocated.select("query", "fid", "mention", "base", "rank", "prefix", F.col("labels").alias("_labels"), F.col("docs").alias("_docs"))
    out = state.join(own, "fid").select("query", "fid", "mention", "epsilon", "base", "rank", "node", "prefix", "path", F.concat("_labels", "labels").alias("labels"), F.concat("_docs", "docs").alias("docs"), "ps")
    return out.withColumn("moved", F.size("path") > F.size("prefix"))


def priority_checker(wanted: Sequence[str]) -> Checker:
    """Offline checker: a chain is useful if its last label is asked for."""
    chosen = set(wanted)
    return lambda chains: [bool(labels) and labels[-1] in chosen for _, labels, _ in chains]


def _judge(checker: Checker):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.copy()
            pdf["useful"] = list(map(bool, checker([(q, list(l), list(p)) for q, l, p in zip(pdf["query"], pdf["labels"], pdf["path"])])))
            yield pdf

    return run


CHAIN = "query string, fid string, mention string, path array<string>, labels array<string>, docs array<string>, node string, base double, rank int, n bigint"


def search(starts: DataFrame, steps: DataFrame, checker: Checker, budget: Budget = Budget()) -> DataFrame:
    """(query, mention, path, labels, docs, node, round): useful chains of every question.

    ``steps(from_node, to_node, fact_id, direction, label, doc_id, priority)``.
    """
    intervals = materialize(edge_intervals(steps), "intervals")
    frontiers = materialize(start_frontiers(starts), "frontiers")
    archive: DataFrame | None = None
    for round_ in range(1, budget.rounds + 1):
        allocated = materialize(allocate(eligible(frontiers, round_, budget), round_, budget), "allocated")
        walked = materialize(walk_together(allocated, intervals, round_, budget), "walked")
        discard(allocated)
        # all that follows is by question, so the chains are shuffled once
        chains = walked.where("moved").select("query", "path", F.struct("fid", "mention", "labels", "docs", "node", "base", "rank").alias("c"), F.size("ps").alias("n")).repartition("query")
        chains = chains.groupBy("query", "path").agg(F.min("c").alias("c"), F.sum("n").alias("n")).select("query", "c.fid", "c.mention", "path", "c.labels", "c.docs", "c.node", "c.base", "c.rank", "n")
        if archive is not None:
            kept = archive.groupBy("query").agg(F.collect_list("path").alias("_kept"))  # at most rounds x check
            chains = chains.join(kept, "query", "left").where(~F.coalesce(F.array_contains("_kept", F.col("path")), F.lit(False))).drop("_kept")
        turn = Window.partitionBy("query", "mention").orderBy(F.size("path").desc(), F.col("n").desc(), F.sha2(F.concat_ws(">", "path"), 256))
        fair = chains.withColumn("_t", F.row_number().over(turn)).withColumn("_p", F.row_number().over(Window.partitionBy("query").orderBy("_t", "mention"))).where(F.col("_p") <= budget.check).drop("_t", "_p")
        judged = materialize(fair.select(*[f.split()[0] for f in CHAIN.split(", ")]).mapInPandas(_judge(checker), CHAIN + ", useful boolean"), "judged")
        found = judged.where("useful").select("query", "mention", "path", "labels", "docs", "node", F.lit(round_).alias("round"))
        before, archive = archive, materialize(found if archive is None else archive.unionByName(found), "archive")
        if before is not None:
            discard(before)
        if round_ == budget.rounds:
            break
        many = lambda held: F.sum(F.when(held, F.size("ps")).otherwise(0))
        counts = walked.groupBy("query", "fid").agg(many(F.col("moved")).alias("_walked"), many(~F.col("moved")).alias("_blocked"))
        seen = judged.groupBy("query", "fid").agg(F.sum("n").alias("_processed"))
        old = frontiers.join(counts, ["query", "fid"], "left").join(seen, ["query", "fid"], "left")
        old = old.withColumn("processed", F.col("processed") + F.coalesce("_processed", F.lit(0))).withColumn("walked", F.col("walked") + F.coalesce("_walked", F.lit(0))).withColumn("blocked", F.col("blocked") + F.coalesce("_blocked", F.lit(0)))
        spent = (F.col("processed") >= budget.lot) | ((F.col("blocked") >= budget.lot) & (F.col("walked") == 0))
        # a wider epsilon is a new policy: what was counted under the old one no longer tells how spent the frontier is
        old = old.withColumn("_raised", spent & (F.col("epsilon") < budget.epsilon_most))
        for c in ("processed", "walked", "blocked"):
            old = old.withColumn(c, F.when(F.col("_raised"), 0).otherwise(F.col(c)))
        old = old.withColumn("epsilon", F.when(F.col("_raised"), F.least(F.col("epsilon") + budget.epsilon_step, F.lit(budget.epsilon_most))).otherwise(F.col("epsilon"))).drop("_raised", "_walked", "_blocked", "_processed")
        more = judged.where("useful and node is not null").select(
            "query", F.sha2(F.concat_ws("|", "query", "mention", "node", F.concat_ws(">", "path")), 256).alias("fid"), "mention", "node", F.col("path").alias("prefix"), "labels", "docs", "base", "rank",
            F.lit(0.0).alias("epsilon"), *[F.lit(0).cast("bigint").alias(c) for c in ("processed", "walked", "blocked")],
        )
        new = materialize(old.unionByName(more).dropDuplicates(["query", "fid"]), "frontiers")
        for df in (frontiers, walked, judged):
            discard(df)
        frontiers = new
    for df in (frontiers, walked, judged, intervals):
        discard(df)
    return archive


def select_documents(archive: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(query, doc, rank): chains in turn (fewer documents, longer, id) while their documents fit the budget.

    A question has at most rounds x check chains, so its rows are folded in one expression.
    """
    key = F.struct(F.size(F.array_distinct("docs")).alias("a"), (-F.size("path")).alias("b"), F.concat_ws(">", "path").alias("c"), F.array_distinct("docs").alias("docs"))
    chains = archive.groupBy("query").agg(F.array_sort(F.collect_list(key)).alias("chains"))
    keep = F.aggregate(
        "chains", F.array().cast("array<string>"), lambda acc, c: F.when(F.size(F.array_union(acc, c["docs"])) <= budget.documents, F.array_union(acc, c["docs"])).otherwise(acc)
    )
    return chains.select("query", F.posexplode(keep).alias("pos", "doc")).select("query", "doc", (F.col("pos") + 1).alias("rank"))


def add_participant_articles(selected: DataFrame, names: DataFrame, documents: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Adds the own article (title equal to a participant's name) while a question has room.

    ``selected(query, doc, rank)``, ``names(query, name, place)``, ``documents(doc, title)``.
    """
    titles = documents.select(norm(F.col("title")).alias("key"), "doc").where("key <> ''").groupBy("key").agg(F.min("doc").alias("doc"))
    own = names.select("query", norm(F.col("name")).alias("key"), "place").join(titles, "key").groupBy("query", "doc").agg((F.min("place") + 1_000_000).cast("int").alias("rank"))
    both = selected.select("query", "doc", F.col("rank").cast("int").alias("rank")).unionByName(own).groupBy("query", "doc").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query").orderBy("rank", "doc")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= budget.documents)


def identity_routes(links: DataFrame, sources: DataFrame, most_hops: int | None = None) -> DataFrame:
    """(start, target, cost, route): cheapest identity route from each source, by rounds of relaxation until nothing improves.

    ``links(left, right, explicit, doc_id)``; cost compares (links that are not explicit, hops) in
    this order, ties by the route; a round keeps one best row a (start, target).
    """
    both = links.select(F.explode(F.array(F.struct(F.col("left").alias("a"), F.col("right").alias("b"), "explicit"), F.struct(F.col("right").alias("a"), F.col("left").alias("b"), "explicit"))).alias("l")).select("l.*").where("a <> b").groupBy("a", "b").agg(F.max("explicit").alias("explicit"))
    both = materialize(both, "links")
    best = sources.select(F.col("node").alias("start"), F.col("node").alias("target"), F.struct(F.lit(0).alias("weak"), F.lit(0).alias("hops"), F.array("node").alias("route")).alias("cost")).distinct()
    hops = 0
    while most_hops is None or hops < most_hops:
        hops += 1
        step = best.join(both, F.col("target") == F.col("a")).where(~F.array_contains("cost.route", F.col("b")))
        step = step.select("start", F.col("b").alias("target"), F.struct((F.col("cost.weak") + (~F.col("explicit")).cast("int")).alias("weak"), (F.col("cost.hops") + 1).alias("hops"), F.array_append("cost.route", F.col("b")).alias("route")).alias("cost"))
        new = materialize(best.unionByName(step).groupBy("start", "target").agg(F.min("cost").alias("cost")), "routes")
        changed = new.exceptAll(best).limit(1).count() > 0
        best = new
        if not changed:
            break
    return best.select("start", "target", F.col("cost.weak").alias("n_weak"), F.col("cost.hops").alias("n_hops"), F.col("cost.route").alias("route"))
