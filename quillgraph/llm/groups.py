"""Consolidating pairwise matches into groups.

Matches form an undirected graph; every record gets the smallest key among all records linked
to it. The graph is shrunk before it is solved:

1. vertices of degree one are stripped, round after round, while a round still removes a good
   share of the edges; each remembers its neighbour;
2. chains of vertices of degree two are compressed to one edge between their ends by list
   ranking (pointer doubling over directed chain positions), so a chain of length L takes
   log2(L) rounds; closed rings are done once a round changes none of their smallest keys;
3. the reduced core is solved by hooking every vertex to its smallest neighbour and
   contracting, which at least halves the vertices that still have edges in each round, until at most
   ``CORE_EDGES`` are left; one executor task unites those;
4. labels are restored in the reverse order of removal.

Scale: every step is an aggregation with map-side combine or a join in which one side has one
row a key, so a record that stands in a third of all pairs is a hot key only on the side that
AQE can split. No list of neighbours is ever built and nothing but counts reaches the driver.
Each round is written to the shared checkpoint folder, so a lost executor costs one round.

Defined results: a pair with a null side is ignored; a record paired with itself is a group of
its own unless another pair links it; repeated and mirrored pairs count once; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import discard, materialize

#: A strip round that removes a smaller share of the edges is the last one before compression.
STRIP_SHARE = 0.05
MAX_STRIP_ROUNDS = 8
#: Edges of the reduced core (two keys each) that one task may unite.
CORE_EDGES = 500_000
#: Strip and compress again while that removed at least this share of the edges.
SHRINK_SHARE = 0.3


def clean_pairs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct undirected pairs (a < b)."""
    l, r = F.col(left).cast("string"), F.col(right).cast("string")
    return pairs.where(l.isNotNull() & r.isNotNull() & (l != r)).select(F.least(l, r).alias("a"), F.greatest(l, r).alias("b")).distinct()


def _degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
    return both.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def _unite(pdf: pd.DataFrame) -> pd.DataFrame:
    """(v, parent): every vertex of a bounded edge list that is not the smallest of its group, with the smallest."""
    keys, ends = pd.factorize(pd.concat([pdf["a"], pdf["b"]], ignore_index=True), sort=True)[::-1]
    up = list(range(len(keys)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    half = len(ends) // 2
    for x, y in zip(ends[:half].tolist(), ends[half:].tolist()):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    labels = [root(x) for x in range(len(keys))]
    moved = [i for i, x in enumerate(labels) if x != i]
    return pd.DataFrame({"v": keys[moved], "parent": keys[[labels[i] for i in moved]]})


class _Solver:
    def __init__(self, edges: DataFrame):
        self.edges = materialize(edges, "edges")
        self.n = self.edges.count()
        self.maps: list[DataFrame] = []  # (v, parent), in order of removal

    def _replace(self, edges: DataFrame) -> int:
        old, before = self.edges, self.n
        self.edges = materialize(edges, "edges")
        self.n = self.edges.count()
        discard(old)
        return before - self.n

    def strip(self) -> int:
        """Remove the vertices of degree one; of a lone pair the smaller key stays."""
        leaves = _degrees(self.edges).where("n = 1").select(F.least("u", "lo").alias("a"), F.greatest("u", "lo").alias("b"), "u")
        gone = materialize(leaves.groupBy("a", "b").agg(F.max("u").alias("v")), "leaves")
        self.maps.append(gone.select("v", F.when(F.col("v") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("parent")))
        return self._replace(self.edges.join(gone.select("a", "b"), ["a", "b"], "left_anti"))

    def compress(self) -> int:
        """Replace chains of degree-two vertices by an edge between their ends."""
        two = materialize(_degrees(self.edges).where("n = 2").select("u", "lo", "hi"), "two")
        waiting = two.count()
        if not waiting:
            return 0
        # a chain position (h, t): at h, having come from t; it leads on to the other neighbour of h
        step = two.select("u", "lo", "hi")
        at = step.select(F.explode(F.array(F.struct(F.col("u").alias("h"), F.col("lo").alias("t"), F.col("hi").alias("fh")), F.struct(F.col("u").alias("h"), F.col("hi").alias("t"), F.col("lo").alias("fh")))).alias("p")).select("p.h", "p.t", "p.fh", F.col("p.h").alias("ft"), F.least("p.h", "p.fh").alias("least"))
        inner = two.select(F.col("u").alias("fh"), F.lit(True).alias("_inner"))
        ranked = materialize(at.join(inner, "fh", "left").select("h", "t", "fh", "ft", "least", F.col("_inner").isNull().alias("done")), "rank")
        waiting = ranked.where("not done").count()
        moving = bool(waiting)
        while moving:
            nxt = ranked.select(F.col("h").alias("fh"), F.col("t").alias("ft"), F.col("fh").alias("_fh"), F.col("ft").alias("_ft"), F.col("least").alias("_least"), F.col("done").alias("_done"))
            jumped = (
                ranked.where("not done")
                .join(nxt, ["fh", "ft"])
                .select("h", "t", F.col("_fh").alias("fh"), F.col("_ft").alias("ft"), F.least("least", "_least").alias("least"), F.col("_done").alias("done"), (F.col("_least") < F.col("least")).alias("lower"))
            )
            old = ranked
            ranked = materialize(ranked.where("done").withColumn("lower", F.lit(False)).select("h", "t", "fh", "ft", "least", "done", "lower").unionByName(jumped), "rank")
            discard(old)
            state = ranked.agg(F.count_if(~F.col("done")).alias("open"), F.count_if("lower").alias("lower")).first()
            # what stays open without an end in reach is a ring, and complete once no smallest key falls
            moving = state["open"] > 0 and (state["open"] < waiting or state["lower"] > 0)
            waiting = state["open"]
        ends = materialize(
            ranked.groupBy("h").agg(F.min(F.when(F.col("done"), F.col("fh"))).alias("e1"), F.max(F.when(F.col("done"), F.col("fh"))).alias("e2"), F.min("least").alias("ring")),
            "ends",
        )
        discard(ranked)
        self.maps.append(ends.where("coalesce(e1, ring) <> h").select(F.col("h").alias("v"), F.coalesce("e1", "ring").alias("parent")))
        inside = two.select(F.col("u").alias("_u"))
        kept = self.edges.join(inside, F.col("a") == F.col("_u"), "left_anti").join(inside, F.col("b") == F.col("_u"), "left_anti")
        bridges = ends.where("e1 < e2").select(F.col("e1").alias("a"), F.col("e2").alias("b"))
        removed = self._replace(kept.unionByName(bridges).distinct())
        discard(two)
        return removed

    def solve_core(self) -> None:
        """Hook each vertex to its smallest neighbour, contract, and repeat until no edge is left."""
        while self.n > CORE_EDGES:
            hook = _degrees(self.edges).select("u", F.least("u", "lo").alias("p"))
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = materialize(hook.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p")), "hook")
            self.maps.append(jumped.where("u <> p").select(F.col("u").alias("v"), F.col("p").alias("parent")))
            pa, pb = jumped.select(F.col("u").alias("a"), F.col("p").alias("pa")), jumped.select(F.col("u").alias("b"), F.col("p").alias("pb"))
            moved = self.edges.join(pa, "a").join(pb, "b").where("pa <> pb")
            self._replace(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if self.n:
            whole = self.edges.select("a", "b").withColumn("_all", F.lit(0))
            self.maps.append(materialize(whole.groupBy("_all").applyInPandas(_unite, "v string, parent string"), "core"))

    def restore(self) -> DataFrame | None:
        """(v, root) of every removed vertex, last removed first."""
        labels = None
        for mapping in reversed(self.maps):
            if labels is None:
                labels = materialize(mapping.select("v", F.col("parent").alias("root")), "labels")
                continue
            up = labels.select(F.col("v").alias("parent"), F.col("root").alias("_root"))
            old = labels
            labels = materialize(labels.unionByName(mapping.join(up, "parent", "left").select("v", F.coalesce("_root", "parent").alias("root"))), "labels")
            discard(old)
        return labels


def connected_groups(pairs: DataFrame, left: str = "left_local", right: str = "right_local") -> DataFrame:
    """(key, group_id): every key of a pair with both sides filled, with the smallest key linked to it."""
    l, r = F.col(left).cast("string"), F.col(right).cast("string")
    keys = pairs.where(l.isNotNull() & r.isNotNull()).select(F.explode(F.array(l, r)).alias("key")).distinct()
    solver = _Solver(clean_pairs(pairs, left, right))
    while solver.n:
        before = solver.n
        for _ in range(MAX_STRIP_ROUNDS):
            edges = solver.n
            if not edges or solver.strip() < STRIP_SHARE * edges:
                break
        if solver.n:
            solver.compress()
        if before - solver.n < SHRINK_SHARE * before:
            break
    solver.solve_core()
    labels = solver.restore()
    if labels is None:
        return keys.select("key", F.col("key").alias("group_id"))
    rooted = materialize(keys.join(labels.select(F.col("v").alias("key"), "root"), "key", "left").select("key", F.coalesce("root", "key").alias("root")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("key").alias("group_id"))
    return rooted.join(smallest, "root").select("key", "group_id")


def entity_groups(identities: DataFrame, local_entities: DataFrame) -> DataFrame:
    """(local_id, group_id) of the local entities that stand in a complete pair."""
    known = local_entities.select(F.col("local_id").alias("key")).where("key is not null").distinct()
    return connected_groups(identities).join(known, "key", "left_semi").select(F.col("key").alias("local_id"), "group_id")
