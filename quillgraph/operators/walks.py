"""Directed walks over views: step probabilities, simple paths, sampled walks, archives and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import norm


def step_probabilities(steps: DataFrame, epsilon: float) -> DataFrame:
    """Adds ``p`` to steps with a boolean ``priority``: priority edges of a node share 1 - epsilon, the rest epsilon.

    A node with edges of one kind spreads evenly, except that non-priority edges alone get nothing
    at epsilon 0.
    """
    w = Window.partitionBy("from_node")
    pri = F.count_if(F.col("priority")).over(w)
    other = F.count_if(~F.col("priority")).over(w)
    p = (
        F.when((pri > 0) & (other > 0), F.when(F.col("priority"), (1 - epsilon) / pri).otherwise(epsilon / other))
        .when(pri > 0, 1 / pri)
        .otherwise(F.when(F.lit(epsilon > 0), 1 / other).otherwise(0.0))
    )
    return steps.withColumn("p", p)


def source_blend(weighted: DataFrame, share: float) -> DataFrame:
    """Moves ``share`` of each node's probability to the edges of the node's own article (boolean ``own``)."""
    w = Window.partitionBy("from_node")
    own_total = F.sum(F.when(F.col("own"), F.col("p"))).over(w)
    own_count = F.count_if(F.col("own")).over(w)
    specific = F.when(~F.col("own"), 0.0).when(own_total > 0, F.col("p") / own_total).otherwise(1 / own_count)
    part = F.when(F.sum("p").over(w) > 0, F.lit(share)).otherwise(F.lit(1.0))
    return weighted.withColumn("p_blended", F.when(own_count == 0, F.col("p")).otherwise((1 - part) * F.col("p") + part * specific))


def two_step_paths(steps: DataFrame, one_document: bool = False) -> DataFrame:
    """(start, fact1, middle, fact2, end): simple paths of two steps; no fact twice, a terminal only last.

    With ``one_document`` only paths whose facts share an article, which then is part of the join key.
    """
    a = steps.where("to_node is not null").select(F.col("from_node").alias("start"), F.col("fact_id").alias("fact1"), F.col("doc_id").alias("doc1"), F.col("to_node").alias("middle"))
    b = steps.select(F.col("from_node").alias("middle"), F.col("fact_id").alias("fact2"), F.col("doc_id").alias("doc2"), F.col("to_node").alias("end"))
    keys = ["middle"] + ["doc1"] * one_document
    both = a.join(b.withColumn("doc1", F.col("doc2")) if one_document else b, keys)
    return both.where("fact1 <> fact2").select("start", "fact1", "middle", "fact2", "end", "doc1", "doc2")


def two_step_counts(steps: DataFrame) -> DataFrame:
    """(start, n_paths, n_open, n_two_documents): what ``two_step_paths`` has from each start, without the pairs.

    A first step meets the number of edges at its end less those of its own fact, so a node of n
    edges costs n rows and not their square.
    """
    key = ["middle", "fact_id", "doc_id"]
    last = steps.select(F.col("from_node").alias("middle"), "fact_id", "doc_id", "to_node")
    of = lambda keys, c: last.groupBy(*keys).agg(F.count("*").alias(f"n{c}"), F.count("to_node").alias(f"o{c}"))
    a = steps.where("to_node is not null").select(F.col("from_node").alias("start"), F.col("to_node").alias("middle"), "fact_id", "doc_id")
    for keys, c in ((key[:1], ""), (key[:2], "_f"), (["middle", "doc_id"], "_d"), (key, "_fd")):
        a = a.join(of(keys, c), keys, "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("n", "o", "n_f", "o_f", "n_d", "n_fd")}
    per = a.select("start", (n["n"] - n["n_f"]).alias("p"), (n["o"] - n["o_f"]).alias("e"), (n["n"] - n["n_d"] - n["n_f"] + n["n_fd"]).alias("t"))
    return per.groupBy("start").agg(F.sum("p").alias("n_paths"), F.sum("e").alias("n_open"), F.sum("t").alias("n_two_documents")).where("n_paths > 0")


def uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) that depends on its arguments only, so retries and partitioning change nothing."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def sample_walks(starts: DataFrame, weighted: DataFrame, walks: int, steps: int, seed: int = 0) -> DataFrame:
    """(start, walk, depth, fact_ids, end): ``walks`` sampled walks from each start of at most ``steps`` steps.

    Each step is a join on the current node with the cumulative probabilities of its edges; the edge
    is the first whose cumulative probability exceeds the hash-derived draw. The range of a node is cut
    into as many parts as it has edges and the part is in the join key, so a draw at a hub meets few
    edges. A fact is never used twice: a walk that draws a used fact stays where it is.
    """
    w = Window.partitionBy("from_node").orderBy("fact_id", "direction", F.coalesce("to_node", F.lit("")))
    upper = F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0))
    edges = weighted.where("p > 0").withColumn("_hi", upper).withColumn("_lo", F.coalesce(F.lag("_hi").over(w), F.lit(0.0))).select(F.col("from_node").alias("node"), F.col("fact_id").alias("_fact"), F.col("to_node").alias("_to"), "_lo", "_hi")
    total = edges.groupBy("node").agg(F.max("_hi").alias("_all"), F.count("*").alias("_n"))
    part = lambda c: F.least(F.floor(F.col(c) * F.col("_n") / F.col("_all")), F.col("_n") - 1)
    edges = edges.join(total, "node").select("node", F.explode(F.sequence(part("_lo"), part("_hi"))).alias("_part"), "_fact", "_to", "_lo", "_hi")
    state = starts.select(F.col("node").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"), F.col("node"), F.array().cast("array<string>").alias("fact_ids"))
    for depth in range(steps):
        drawn = state.join(total, "node", "left").withColumn("_u", uniform(F.lit(seed), F.col("start"), F.col("walk"), F.lit(depth)) * F.col("_all"))
        drawn = drawn.withColumn("_part", part("_u")).drop("_all", "_n")
        at = edges.select(F.col("node").alias("_node"), F.col("_part").alias("_at"), "_fact", "_to", "_lo", "_hi")
        hit = drawn.join(at, (F.col("node") == F.col("_node")) & (F.col("_part") == F.col("_at")) & (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")), "left")
        fresh = F.col("_fact").isNotNull() & ~F.array_contains("fact_ids", F.coalesce("_fact", F.lit("")))
        state = hit.select("start", "walk", F.when(fresh, F.col("_to")).otherwise(F.col("node")).alias("node"), F.when(fresh, F.array_append("fact_ids", F.col("_fact"))).otherwise(F.col("fact_ids")).alias("fact_ids"))
    return state.select("start", "walk", F.size("fact_ids").alias("depth"), "fact_ids", F.col("node").alias("end"))


def _words(c):
    return F.filter(F.split(F.regexp_replace(norm(c), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def record_names(local_entities: DataFrame) -> DataFrame:
    """(local_id, mention): the words of every name of a record."""
    names = local_entities.where("local_id is not null and name is not null").select("local_id", F.array_join(_words(F.col("name")), " ").alias("mention"))
    return names.where("mention <> ''").distinct()


def question_runs(queries: DataFrame, local_entities: DataFrame) -> DataFrame:
    """(query_id, mention): the question's runs of words, of every length that a name can have."""
    q = queries.where("question is not null").select("query_id", "question").distinct().withColumn("w", _words(F.col("question")))
    longest = local_entities.where("local_id is not null and name is not null").agg(F.coalesce(F.max(F.size(_words(F.col("name")))), F.lit(0)).alias("most"))  # one row
    sized = q.join(F.broadcast(longest), F.lit(True)).select("query_id", "w", F.size("w").alias("s"), F.least(F.size("w"), "most").alias("most")).where("most > 0")
    runs = sized.select("query_id", "w", "s", F.explode(F.sequence(F.lit(1), F.col("most"))).alias("n"))
    return runs.select("query_id", F.explode(F.transform(F.sequence(F.lit(1), F.col("s") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("mention")).distinct()


def question_mentions(queries: DataFrame, local_entities: DataFrame) -> DataFrame:
    """(query_id, local_id, mention): records whose normalised name stands in the question as whole words.

    The question's runs of words meet the names in an equi-join, so no question is compared with every name.
    """
    return question_runs(queries, local_entities).join(record_names(local_entities), "mention").select("query_id", "local_id", "mention")


def ranked_documents(mentions: DataFrame, local_entities: DataFrame, k: int) -> DataFrame:
    """(query, doc, score, rank): documents of the mentioned records, by distinct mentions, longer mentions first."""
    docs = local_entities.select("local_id", F.col("doc_id").try_cast("bigint").alias("doc")).where("doc is not null").distinct()
    per = mentions.join(docs, "local_id").groupBy(F.col("query_id").alias("query"), "doc").agg(F.countDistinct("mention").alias("score"), F.max(F.length("mention")).alias("_longest"))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("_longest").desc(), F.col("doc"))
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "doc", "score", "rank")


def frontier_priors(candidates: DataFrame, temperature: float = 0.1) -> DataFrame:
    """Adds ``prior`` to (query, id, score, exact): exp of the distance to the best score; an exact match at least 1."""
    top = F.max("score").over(Window.partitionBy("query"))
    base = F.exp((F.col("score") - top) / temperature)
    return candidates.withColumn("prior", F.when(F.col("exact"), F.greatest(base, F.lit(1.0))).otherwise(base))


def fair_batch(pending: DataFrame, capacity: int) -> DataFrame:
    """At most ``capacity`` pending chains a query (query, mention, path_id, prefix), shared evenly between mentions."""
    own = Window.partitionBy("query", "mention").orderBy(F.col("prefix").desc(), "path_id")
    turn = pending.withColumn("turn", F.row_number().over(own))
    w = Window.partitionBy("query").orderBy("turn", "mention")
    return turn.withColumn("place", F.row_number().over(w)).where(F.col("place") <= capacity)


def compact_archives(archives: DataFrame) -> DataFrame:
    """(owner, old, new): archives (owner, id, path, docs) that a longer archive makes redundant.

    A longer archive replaces one whose path is its exact prefix when it adds no document; the
    shortest such archive is named. Prefixes meet in an equi-join on their text, not pairwise.
    """
    longer = archives.where(F.size("path") > 1).select("owner", F.col("id").alias("new"), F.col("docs").alias("new_docs"), F.size("path").alias("length"), F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("n"), "path")
    longer = longer.select("owner", "new", "new_docs", "length", F.array_join(F.slice("path", 1, F.col("n")), ">").alias("prefix"))
    old = archives.select("owner", F.col("id").alias("old"), F.col("docs").alias("old_docs"), F.array_join("path", ">").alias("prefix"))
    fits = old.join(longer, ["owner", "prefix"]).where(F.size(F.array_except("new_docs", "old_docs")) == 0)
    return fits.groupBy("owner", "old").agg(F.min(F.struct("length", "new")).alias("b")).select("owner", "old", F.col("b.new").alias("new"))
