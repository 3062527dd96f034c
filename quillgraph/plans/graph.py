"""Queries over fact tables and the graphs made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import facts as O
from quillgraph.operators import graph as G
from quillgraph.operators import identity as I
from quillgraph.operators import walks as W
from quillgraph.operators.retrieval import similarity_edges
from quillgraph.plans.text import sql_collapse, sql_role_inverse
from quillgraph.session import materialize, read_table

#: Relation labels that count as asked for in the walk queries.
PRIORITY = ("was born in", "is located in", "was founded by", "worked for", "is a")
EPSILON = 0.1
SIMILAR = 0.3


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [read_table(spark, sf_dir, n) for n in names]


def fact_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = O.distinct_facts(read_table(spark, sf_dir, "facts")).withColumn("faults", O.faults())
    return f.groupBy("source_type", F.array_join("faults", ",").alias("faults")).agg(F.count("*").alias("n_facts"))


def fact_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.routes(O.distinct_facts(read_table(spark, sf_dir, "facts"))).groupBy("source_type", "route").agg(F.count("*").alias("n_facts"))


def fact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.fact_report(read_table(spark, sf_dir, "facts"))


def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.entity_groups(read_table(spark, sf_dir, "local_entities")).select("type", "name_key", "entity_name", "n_records", "n_spellings")


def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    le = read_table(spark, sf_dir, "local_entities")
    occ = O.occurrences(le).join(le.groupBy("local_id").agg(F.min("type").alias("type")), "local_id")
    return occ.groupBy("type", "role").agg(F.count("*").alias("n_occurrences"), F.countDistinct("local_id").alias("n_records"))


def context_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.context_facts(*_t(spark, sf_dir, "facts", "local_entities"))


def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.context_lines(*_t(spark, sf_dir, "facts", "local_entities")).select("local_id", "place", F.sha2("line", 256).alias("line_hash"))


def directed_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.directed_views(read_table(spark, sf_dir, "facts"))


def view_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directed_views(spark, sf_dir).groupBy("direction", "label").agg(F.count("*").alias("n_views"))


def inverse_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.inverse_examples(*_t(spark, sf_dir, "facts", "local_entities"))


def missing_locals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.invariant_violations(*_t(spark, sf_dir, "facts", "local_entities"))


def pending_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.pending_documents(*_t(spark, sf_dir, "documents", "facts"))


def fact_entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fact_entity_edges(O.distinct_facts(read_table(spark, sf_dir, "facts")))


def degree_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degree_report(G.symmetric(fact_entity_edges(spark, sf_dir), "fact_id", "entity"))


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the order graph: regions, nations and suppliers, by size."""
    n, s = _t(spark, sf_dir, "nation", "supplier")
    e = n.select(F.concat(F.lit("nation:"), "n_nationkey").alias("a"), F.concat(F.lit("region:"), "n_regionkey").alias("b")).unionByName(
        s.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("a"), F.concat(F.lit("nation:"), "s_nationkey").alias("b"))
    )
    return G.components(G.symmetric(e, "a", "b")).groupBy("component").agg(F.count("*").alias("n_vertices"))


def _fact_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between facts and records, in both directions."""
    return materialize(G.symmetric(fact_entity_edges(spark, sf_dir).select(F.concat(F.lit("f:"), "fact_id").alias("a"), F.concat(F.lit("e:"), "entity").alias("b")), "a", "b"), "fact_graph")


def fact_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the graph of facts and records, by size."""
    c = G.components(_fact_graph(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("n_vertices"))
    return c.groupBy("n_vertices").agg(F.count("*").alias("n_components"))


def graph_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on the graph of facts and records: vertices of each kind, edges, isolated records, degrees, components."""
    edges = _fact_graph(spark, sf_dir)
    degree = edges.groupBy("src").agg(F.count("*").alias("d")).agg(
        F.count_if(F.col("src").startswith("f:")).alias("n_facts"), F.count_if(F.col("src").startswith("e:")).alias("n_entities"), F.sum("d").alias("_both"), F.max("d").alias("max_degree"), F.round(F.avg("d"), 6).alias("mean_degree")
    )
    known = read_table(spark, sf_dir, "local_entities").where("local_id is not null").select(F.concat(F.lit("e:"), "local_id").alias("src")).distinct()
    alone = known.join(edges, "src", "left_anti").agg(F.count("*").alias("n_isolated"))
    parts = G.components(edges).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_components"), F.max("n").alias("largest_component"))
    one = lambda df: F.broadcast(df.withColumn("_one", F.lit(1)))  # noqa: E731  # single rows
    out = degree.withColumn("_one", F.lit(1)).join(one(alone), "_one").join(one(parts), "_one")
    return out.select("n_facts", "n_entities", (F.col("_both") / 2).cast("bigint").alias("n_edges"), "n_isolated", "max_degree", "mean_degree", "n_components", "largest_component")


def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read_table(spark, sf_dir, "embeddings").select(F.col("label").alias("type"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return similarity_edges(v, SIMILAR).select("type", "a", "b", F.round("score", 6).alias("score"))


def transition_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order to part transitions, with the number of line items as weight."""
    li = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return G.transitions(li).select("src", "dst", F.round("p", 9).alias("p"))


def dangling_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = _t(spark, sf_dir, "orders", "lineitem")
    return o.select("o_orderkey").join(li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


def edge_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _walk_steps(spark, sf_dir)
    p = W.step_probabilities(steps, EPSILON)
    return p.select("from_node", "fact_id", "direction", F.round("p", 9).alias("p"))


def _walk_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [f"X {r} Y" for r in PRIORITY]
    views = directed_views(spark, sf_dir)
    return views.select("fact_id", "doc_id", "direction", F.col("from_local").alias("from_node"), F.col("to_local").alias("to_node"), F.col("label").isin(wanted).alias("priority"), (F.col("doc_id") == F.substring_index("from_local", "#", 1)).alias("own"))


def canonical_steps(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """The views between canonical nodes: records that identities join are one node, so a walk passes from article to article."""
    wanted = [f"X {r} Y" for r in PRIORITY]
    steps = O.steps(directed_views(spark, sf_dir), known or I.explicit_mapping(read_table(spark, sf_dir, "identities")))
    return steps.withColumn("priority", F.coalesce(F.col("label").isin(wanted), F.lit(False)))


def canonical_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = W.step_probabilities(canonical_steps(spark, sf_dir), EPSILON)
    return p.select("from_node", "fact_id", "direction", F.round("p", 9).alias("p"))


def blended_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = W.source_blend(W.step_probabilities(_walk_steps(spark, sf_dir), EPSILON), 0.5)
    return p.select("from_node", "fact_id", "direction", F.round("p_blended", 9).alias("p"))


def two_step_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple two-step paths between records: how many, and over how many documents, from each start."""
    paths = W.two_step_paths(_walk_steps(spark, sf_dir))
    return paths.groupBy("start").agg(F.count("*").alias("n_paths"), F.count("end").alias("n_open"), F.count_if(F.col("doc1") != F.col("doc2")).alias("n_two_documents"))


def canonical_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple two-step paths between canonical nodes, counted as in two_step_paths."""
    return W.two_step_counts(canonical_steps(spark, sf_dir))


def archive_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-step and two-step paths as archives: which a longer one without a new document replaces."""
    steps = _walk_steps(spark, sf_dir)
    one = steps.select(F.col("from_node").alias("owner"), F.col("fact_id").alias("id"), F.array("fact_id").alias("path"), F.array("doc_id").alias("docs")).distinct()
    two = W.two_step_paths(steps).select(F.col("start").alias("owner"), F.concat_ws(">", "fact1", "fact2").alias("id"), F.array("fact1", "fact2").alias("path"), F.array_distinct(F.array("doc1", "doc2")).alias("docs")).distinct()
    return W.compact_archives(one.unionByName(two))


def canonical_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive_compaction between canonical nodes; only a second step of the same article adds no document."""
    steps = materialize(canonical_steps(spark, sf_dir), "steps")
    one = steps.select(F.col("from_node").alias("owner"), F.col("fact_id").alias("id"), F.array("fact_id").alias("path"), F.array("doc_id").alias("docs")).distinct()
    two = W.two_step_paths(steps, one_document=True).select(F.col("start").alias("owner"), F.concat_ws(">", "fact1", "fact2").alias("id"), F.array("fact1", "fact2").alias("path"), F.array("doc1").alias("docs")).distinct()
    return W.compact_archives(one.unionByName(two))


def fair_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next chains to check per article, shared evenly between its records."""
    steps = _walk_steps(spark, sf_dir)
    pending = steps.select(F.col("doc_id").alias("query"), F.col("from_node").alias("mention"), F.col("fact_id").alias("path_id"), F.lit(1).alias("prefix")).distinct()
    return W.fair_batch(pending, 20).select("query", "mention", "path_id", "turn", "place")


def sampled_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-step walks from every canonical node that has a priority edge, ten each."""
    p = materialize(W.step_probabilities(canonical_steps(spark, sf_dir), EPSILON), "steps")
    starts = p.where("priority").select(F.col("from_node").alias("node")).distinct()
    return W.sample_walks(starts, p, walks=10, steps=2)


def exact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.exact_name_candidates(read_table(spark, sf_dir, "local_entities")).select("left", "right", "grp")


def name_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the complete-link merge over equal names whose context vectors agree."""
    le, ev = _t(spark, sf_dir, "local_entities", "embedding_vectors")
    from quillgraph.functions.vectors import unit

    usable = ev.where("vector is not null and size(vector) = 64").where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)))
    v = usable.groupBy(F.col("vector_key").alias("local_id")).agg(F.max_by("vector", F.struct("created_at", "vector")).alias("v")).select("local_id", unit(F.col("v")).alias("v"))
    v = materialize(v, "vectors")
    # the star of a name stands on a record with a usable vector, else the whole name would be lost
    star = I.score_candidates(I.exact_name_candidates(le.join(v, "local_id", "left_semi")), v, 0.8).select("left", "right", F.round("score", 12).alias("score"))
    scored = star.unionByName(I.nearest_name_candidates(le, v, 0.8)).groupBy("left", "right").agg(F.max("score").alias("score"))
    return I.greedy_merge(materialize(scored, "candidates"), 0.8, vectors=v)


def _unit_vectors(ev: DataFrame) -> DataFrame:
    from quillgraph.functions.vectors import unit

    usable = ev.where("vector is not null and size(vector) = 64").where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0))
    return usable.groupBy(F.col("vector_key").alias("local_id")).agg(F.max_by("vector", F.struct("created_at", "vector")).alias("v")).select("local_id", unit(F.col("v")).alias("v"))


def identity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest candidates of the records of every hundredth article, within a type and across the unknown one, with the reason why a pair needs no review."""
    le, ev = _t(spark, sf_dir, "local_entities", "embedding_vectors")
    asked = le.where(F.col("doc_id").try_cast("bigint") % 100 == 0)
    found = I.nearest_candidates(asked, le, materialize(_unit_vectors(ev), "vectors"), 0.8)
    return I.review_filter(found, le).select("left", "right", F.round("score", 6).alias("score"), "route", "reason")


def typed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by explicit links between records of compatible types, by size."""
    ids, le = _t(spark, sf_dir, "identities", "local_entities")
    return I.explicit_mapping(ids, le).groupBy("entity_id").agg(F.count("*").alias("n_members")).groupBy("n_members").agg(F.count("*").alias("n_entities"))


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken in as a stream, each once, into a table; counted there by type."""
    import uuid

    from quillgraph.session import shared_dir
    from quillgraph.streaming import ingest

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = ingest.read_stream(spark, sf_dir, read_table(spark, sf_dir, "events").schema, glob="events.parquet")
    ingest.append_table(ingest.once(stream.select("event_id", "ts", "event_type"), "event_id", "ts", late="3650 days"), f"{at}/table", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/table").groupBy("event_type").agg(F.count("*").alias("n_events"))


def explicit_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, le = _t(spark, sf_dir, "identities", "local_entities")
    return I.canonical_entities(I.explicit_mapping(ids), le).groupBy("n_members").agg(F.count("*").alias("n_entities"), F.sum("n_names").alias("n_names"))


def pagerank_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten restarted steps from every region over the region, nation and supplier graph."""
    n, s, r = _t(spark, sf_dir, "nation", "supplier", "region")
    e = n.select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b")).unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("n"), "s_nationkey").alias("b")))
    seeds = r.select(F.col("r_name").alias("query"), F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(1.0).alias("p"))
    out = G.personalised_pagerank(G.symmetric(e, "a", "b"), seeds, alpha=0.65, iterations=10)
    return out.select("query", "node", F.round("score", 9).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        fact_validation, fact_routes, fact_report, entity_groups, mention_counts, context_facts, context_lines, directed_views, view_labels, inverse_examples,
        missing_locals, pending_documents, fact_entity_edges, degree_report, graph_components, fact_components, graph_report, similar_pairs, transition_shares, dangling_orders,
        edge_probabilities, blended_probabilities, two_step_paths, archive_compaction, canonical_probabilities, canonical_paths, canonical_archives, fair_batch, sampled_walks, exact_names, name_merge, identity_candidates, typed_entities, streamed_events,
        explicit_entities, pagerank_suppliers,
    )
}

_FACTS = """f AS (SELECT DISTINCT fact_id, doc_id, subject_local, object_local, relation, raw_relation, literal_raw, literal_type, fact_kind, source_type, source_direction, inverse_relation FROM facts)"""
_VIEWS = f"""{_FACTS}, i AS (SELECT *, coalesce(inverse_relation, {sql_role_inverse('raw_relation')}) AS inv FROM f),
    views AS (
        SELECT fact_id, doc_id, CASE WHEN object_local IS NULL THEN 'terminal' ELSE 'forward' END AS direction, subject_local AS from_local, object_local AS to_local, relation AS label FROM i WHERE subject_local IS NOT NULL
        UNION ALL SELECT fact_id, doc_id, 'reverse', object_local, subject_local, 'X ' || inv || ' Y' FROM i WHERE object_local IS NOT NULL AND inv IS NOT NULL)"""
_STEPS = f"""{_VIEWS}, steps AS (SELECT fact_id, doc_id, direction, from_local AS from_node, to_local AS to_node,
        coalesce(label IN ({", ".join(f"'X {r} Y'" for r in PRIORITY)}), false) AS priority, doc_id = split_part(from_local, '#', 1) AS own FROM views),
    np AS (SELECT *, count(*) FILTER (priority) OVER (PARTITION BY from_node) AS a, count(*) FILTER (NOT priority) OVER (PARTITION BY from_node) AS b FROM steps),
    prob AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN CASE WHEN priority THEN (1 - {EPSILON}::DOUBLE) / a ELSE {EPSILON}::DOUBLE / b END WHEN a > 0 THEN 1.0::DOUBLE / a ELSE 1.0::DOUBLE / b END AS p FROM np)"""
_TWO = """two AS (SELECT x.from_node AS start, x.fact_id AS fact1, y.fact_id AS fact2, y.to_node AS e, x.doc_id AS doc1, y.doc_id AS doc2 FROM steps x JOIN steps y ON x.to_node = y.from_node WHERE x.fact_id <> y.fact_id)"""
_NODES = """links AS (SELECT left_local AS a, right_local AS b FROM identities WHERE left_local IS NOT NULL AND right_local IS NOT NULL),
    near AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach(v, r) AS (SELECT a, a FROM near UNION SELECT near.b, reach.r FROM reach JOIN near ON reach.v = near.a),
    nodes AS (SELECT v, 'E_' || substr(sha256('{"root":"' || min(r) || '"}'), 1, 20) AS e FROM reach GROUP BY v)"""
_CANONICAL = f"""{_NODES}, {_STEPS.replace("from_local AS from_node, to_local AS to_node,", "coalesce(a.e, from_local) AS from_node, coalesce(b.e, to_local) AS to_node,").replace("AS own FROM views", "AS own FROM views LEFT JOIN nodes a ON a.v = from_local LEFT JOIN nodes b ON b.v = to_local")}"""
_FAULT = lambda cond, code: f"CASE WHEN coalesce({cond}, true) THEN '{code}' END"

_UNIT = """uv AS (SELECT vector_key AS local_id, list_transform(v, lambda x: x / n) AS v FROM (
        SELECT vector_key, v, sqrt(list_inner_product(v, v)) AS n FROM (
            SELECT vector_key, vector::DOUBLE[] AS v, row_number() OVER (PARTITION BY vector_key ORDER BY created_at DESC, vector DESC) AS r FROM embedding_vectors
            WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0) WHERE r = 1))"""

_FACT_GRAPH = """e AS (SELECT DISTINCT 'f:' || fact_id AS f, 'e:' || x AS n FROM (SELECT fact_id, unnest([subject_local, object_local]) AS x FROM facts) WHERE x IS NOT NULL),
    s AS (SELECT f AS a, n AS b FROM e UNION SELECT n, f FROM e),
    reach(v, r) AS (SELECT a, a FROM s UNION SELECT s.b, reach.r FROM reach JOIN s ON reach.v = s.a),
    c AS (SELECT root, count(*) AS n FROM (SELECT v, min(r) AS root FROM reach GROUP BY v) GROUP BY root)"""

ORACLE_SQL = {
    "fact_components": f"WITH RECURSIVE {_FACT_GRAPH} SELECT n AS n_vertices, count(*) AS n_components FROM c GROUP BY n",
    "graph_report": f"""WITH RECURSIVE {_FACT_GRAPH}, d AS (SELECT a, count(*) AS d FROM s GROUP BY a)
        SELECT count(*) FILTER (a LIKE 'f:%') AS n_facts, count(*) FILTER (a LIKE 'e:%') AS n_entities, (SELECT count(*) FROM e) AS n_edges,
            (SELECT count(DISTINCT local_id) FROM local_entities WHERE 'e:' || local_id NOT IN (SELECT n FROM e)) AS n_isolated,
            max(d) AS max_degree, round(avg(d), 6) AS mean_degree, (SELECT count(*) FROM c) AS n_components, (SELECT max(n) FROM c) AS largest_component FROM d""",
    "identity_candidates": f"""WITH {_UNIT},
        k AS (SELECT local_id, min(type) AS type, min(doc_id) AS doc, min(name) AS name, bool_or(try_cast(doc_id AS BIGINT) % 100 = 0) AS asked FROM local_entities WHERE local_id IS NOT NULL GROUP BY 1),
        b AS (SELECT k.*, CASE WHEN type IN ('Other', 'Unknown') OR type IS NULL THEN 'OTHER' ELSE type END AS grp, v FROM k JOIN uv USING (local_id)),
        p AS (SELECT q.local_id AS query, b.local_id AS id, round(list_inner_product(q.v, b.v), 9) AS s, q.grp = b.grp AS same, (q.grp = 'OTHER') <> (b.grp = 'OTHER') AS across FROM b q JOIN b ON q.asked AND q.local_id <> b.local_id),
        r AS (SELECT query, id, s, 'type' AS route, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM p WHERE same
              UNION ALL SELECT query, id, s, 'boundary', row_number() OVER (PARTITION BY query ORDER BY s DESC, id) FROM p WHERE across),
        c AS (SELECT least(query, id) AS l, greatest(query, id) AS r, max(s) AS score, max(route) AS route FROM r WHERE rank <= 12 AND s >= 0.8 GROUP BY ALL)
        SELECT l AS "left", r AS "right", round(score, 6) AS score, route,
            CASE WHEN trim(regexp_replace(lower(nfc_normalize(a.name)), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(nfc_normalize(b.name)), '\\s+', ' ', 'g')) THEN 'equal_name'
                 WHEN a.grp <> b.grp AND a.grp <> 'OTHER' AND b.grp <> 'OTHER' THEN 'type_conflict' WHEN a.doc = b.doc THEN 'same_document' ELSE 'review' END AS reason
        FROM c JOIN b a ON a.local_id = c.l JOIN b ON b.local_id = c.r""",
    "typed_entities": """WITH RECURSIVE k AS (SELECT local_id, min(type) AS type FROM local_entities WHERE local_id IS NOT NULL GROUP BY 1),
        g AS (SELECT local_id, CASE WHEN type IN ('Other', 'Unknown') OR type IS NULL THEN 'OTHER' ELSE type END AS grp FROM k),
        l AS (SELECT left_local AS a, right_local AS b FROM identities i LEFT JOIN g x ON x.local_id = left_local LEFT JOIN g y ON y.local_id = right_local
              WHERE left_local IS NOT NULL AND right_local IS NOT NULL AND left_local <> right_local
                AND (coalesce(x.grp, 'OTHER') = coalesce(y.grp, 'OTHER') OR coalesce(x.grp, 'OTHER') = 'OTHER' OR coalesce(y.grp, 'OTHER') = 'OTHER')),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        reach(v, r) AS (SELECT a, a FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON reach.v = e.a),
        c AS (SELECT v, min(r) AS root FROM reach GROUP BY v), n AS (SELECT root, count(*) AS n_members FROM c GROUP BY root)
        SELECT n_members, count(*) AS n_entities FROM n GROUP BY 1""",
    "streamed_events": "SELECT event_type, count(DISTINCT event_id) AS n_events FROM events GROUP BY 1",
    "context_lines": """
        WITH n AS (SELECT local_id, min(name) AS name FROM local_entities WHERE local_id IS NOT NULL GROUP BY 1),
        f AS (SELECT DISTINCT subject_local, object_local, raw_relation, literal_raw, array_to_string(list_transform(list_sort(map_entries(qualifiers)), lambda x: x.key || '=' || coalesce(x.value, '')), '; ') AS told FROM facts),
        l AS (SELECT subject_local, object_local, concat_ws(' | ', s.name, raw_relation, coalesce(o.name, literal_raw)) || CASE WHEN coalesce(told, '') <> '' THEN ' [' || told || ']' ELSE '' END AS line
              FROM f JOIN n s ON s.local_id = subject_local LEFT JOIN n o ON o.local_id = object_local),
        d AS (SELECT DISTINCT unnest([subject_local, object_local]) AS local_id, line FROM l)
        SELECT local_id, row_number() OVER (PARTITION BY local_id ORDER BY line) AS place, sha256(line) AS line_hash FROM d WHERE local_id IS NOT NULL""",
    "fact_validation": f"""WITH {_FACTS} SELECT source_type, concat_ws(',',
            {_FAULT("source_type NOT IN ('ENTITY_LINK', 'ENTITY_TO_DETAIL', 'DETAIL_TO_ENTITY', 'TEXT_FACT', 'SAME_ENTITY')", 'kind')},
            {_FAULT("subject_local IS NULL OR trim(subject_local) = ''", 'subject')},
            {_FAULT("raw_relation IS NULL OR trim(raw_relation) = ''", 'relation')},
            {_FAULT("(object_local IS NULL) = (literal_raw IS NULL)", 'object_xor_literal')},
            {_FAULT("source_type = 'ENTITY_LINK' AND object_local IS NULL", 'link_without_object')},
            {_FAULT("source_type IN ('ENTITY_TO_DETAIL', 'DETAIL_TO_ENTITY') AND object_local IS NOT NULL", 'detail_with_object')},
            {_FAULT("(source_type = 'DETAIL_TO_ENTITY') <> (source_direction = 'reverse')", 'direction')},
            {_FAULT("relation <> 'X ' || raw_relation || ' Y'", 'wrapping')}) AS faults, count(*) AS n_facts FROM f GROUP BY ALL""",
    "fact_routes": f"""WITH {_FACTS} SELECT source_type, CASE WHEN source_type = 'TEXT_FACT' THEN 'text' WHEN source_type = 'SAME_ENTITY' THEN 'identity' WHEN object_local IS NULL THEN 'terminal'
            WHEN coalesce(inverse_relation, {sql_role_inverse('raw_relation')}) IS NULL THEN 'reverse_fallback' ELSE 'directed' END AS route, count(*) AS n_facts FROM f GROUP BY ALL""",
    "fact_report": """WITH p AS (SELECT fact_id, min(source_type) AS source_type, count(*) AS n, min(object_local) AS o, min(inverse_relation) AS i FROM facts GROUP BY fact_id)
        SELECT source_type, count(*) AS n_facts, sum(n)::BIGINT AS n_deliveries, count(*) FILTER (o IS NULL) AS n_literals, count(*) FILTER (o IS NOT NULL AND i IS NULL) AS n_without_inverse FROM p GROUP BY source_type""",
    "entity_groups": f"""
        WITH s AS (SELECT DISTINCT local_id, type, nfc_normalize({sql_collapse('name')}) AS spelling FROM local_entities WHERE name IS NOT NULL),
        c AS (SELECT type, spelling, count(*) AS n FROM s GROUP BY ALL),
        k AS (SELECT *, lower(spelling) AS name_key FROM c)
        SELECT type, name_key, first(spelling ORDER BY n DESC, spelling) AS entity_name, sum(n)::BIGINT AS n_records, count(*) AS n_spellings FROM k GROUP BY type, name_key""",
    "mention_counts": """
        WITH o AS (SELECT DISTINCT local_id, doc_id, m.occurrence_id AS oid, m.name AS n FROM (SELECT local_id, doc_id, unnest(mentions) AS m FROM local_entities)),
        t AS (SELECT local_id, min(type) AS type FROM local_entities GROUP BY local_id)
        SELECT type, split_part(oid, ':', -1) AS role, count(*) AS n_occurrences, count(DISTINCT local_id) AS n_records FROM o JOIN t USING (local_id) GROUP BY ALL""",
    "context_facts": f"""
        WITH {_FACTS}, n AS (SELECT local_id, min(name) AS name FROM local_entities WHERE local_id IS NOT NULL GROUP BY local_id),
        l AS (SELECT subject_local, object_local, concat_ws(' | ', s.name, raw_relation, coalesce(o.name, literal_raw)) AS line FROM f JOIN n s ON s.local_id = subject_local LEFT JOIN n o ON o.local_id = object_local),
        b AS (SELECT DISTINCT local_id, line FROM (SELECT subject_local AS local_id, line FROM l UNION ALL SELECT object_local, line FROM l WHERE object_local IS NOT NULL))
        SELECT local_id, count(*) AS n_contexts, min(line) AS first_context, max(line) AS last_context FROM b GROUP BY local_id""",
    "directed_views": f"WITH {_VIEWS} SELECT * FROM views",
    "view_labels": f"WITH {_VIEWS} SELECT direction, label, count(*) AS n_views FROM views GROUP BY ALL",
    "inverse_examples": f"""
        WITH {_FACTS}, t AS (SELECT local_id, min(type) AS type FROM local_entities WHERE local_id IS NOT NULL GROUP BY local_id),
        e AS (SELECT raw_relation, s.type AS subject_type, o.type AS object_type, doc_id, fact_id FROM f JOIN t s ON s.local_id = subject_local JOIN t o ON o.local_id = object_local WHERE source_type = 'ENTITY_LINK' AND inverse_relation IS NULL),
        g AS (SELECT *, row_number() OVER (PARTITION BY raw_relation, subject_type, object_type ORDER BY doc_id, fact_id) AS r FROM e),
        x AS (SELECT *, row_number() OVER (PARTITION BY raw_relation ORDER BY doc_id, fact_id) AS example FROM g WHERE r = 1)
        SELECT raw_relation, subject_type, object_type, fact_id, example FROM x WHERE example <= 3""",
    "missing_locals": f"""
        WITH {_FACTS}, e AS (SELECT fact_id, 'subject' AS role, subject_local AS ref FROM f UNION ALL SELECT fact_id, 'object', object_local FROM f)
        SELECT role, count(DISTINCT fact_id) AS n_facts, count(DISTINCT ref) AS n_missing FROM e WHERE ref IS NOT NULL AND ref NOT IN (SELECT local_id FROM local_entities WHERE local_id IS NOT NULL) GROUP BY role""",
    "pending_documents": "SELECT doc_id FROM documents WHERE trim(text) <> '' AND doc_id NOT IN (SELECT try_cast(doc_id AS BIGINT) FROM facts WHERE try_cast(doc_id AS BIGINT) IS NOT NULL)",
    "fact_entity_edges": f"WITH {_FACTS} SELECT DISTINCT fact_id, entity FROM (SELECT fact_id, subject_local AS entity FROM f UNION ALL SELECT fact_id, object_local FROM f) WHERE entity IS NOT NULL",
    "degree_report": f"""WITH {_FACTS}, e AS (SELECT DISTINCT fact_id, entity FROM (SELECT fact_id, subject_local AS entity FROM f UNION ALL SELECT fact_id, object_local FROM f) WHERE entity IS NOT NULL),
        d AS (SELECT fact_id AS v, count(*) AS degree FROM e GROUP BY 1 UNION ALL SELECT entity, count(*) FROM e GROUP BY 1) SELECT degree, count(*) AS n_vertices FROM d GROUP BY degree""",
    "graph_components": """
        WITH RECURSIVE e AS (SELECT 'nation:' || n_nationkey AS a, 'region:' || n_regionkey AS b FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier),
        s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(v, r) AS (SELECT a, a FROM s UNION SELECT s.b, reach.r FROM reach JOIN s ON reach.v = s.a)
        SELECT component, count(*) AS n_vertices FROM (SELECT v, min(r) AS component FROM reach GROUP BY v) GROUP BY component""",
    "similar_pairs": f"""WITH p AS (SELECT x.label AS type, x.vec_id AS a, y.vec_id AS b, list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS s FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id)
        SELECT type, a, b, round(s, 6) AS score FROM p WHERE s >= {SIMILAR}""",
    "transition_shares": "WITH w AS (SELECT l_orderkey AS src, l_partkey AS dst, count(*) AS w FROM lineitem GROUP BY ALL) SELECT src, dst, round(w::DOUBLE / sum(w) OVER (PARTITION BY src), 9) AS p FROM w",
    "dangling_orders": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "edge_probabilities": f"WITH {_STEPS} SELECT from_node, fact_id, direction, round(p, 9) AS p FROM prob",
    "blended_probabilities": f"""WITH {_STEPS}, o AS (SELECT *, sum(CASE WHEN own THEN p END) OVER w AS ot, count(*) FILTER (own) OVER w AS oc FROM prob WINDOW w AS (PARTITION BY from_node))
        SELECT from_node, fact_id, direction, round(CASE WHEN oc = 0 THEN p ELSE 0.5::DOUBLE * p + 0.5::DOUBLE * CASE WHEN own THEN p / ot ELSE 0 END END, 9) AS p FROM o""",
    "two_step_paths": f"WITH {_STEPS}, {_TWO} SELECT start, count(*) AS n_paths, count(e) AS n_open, count(*) FILTER (doc1 <> doc2) AS n_two_documents FROM two GROUP BY start",
    "archive_compaction": f"""WITH {_STEPS}, {_TWO}, t AS (SELECT DISTINCT start, fact1, fact2 FROM two WHERE doc1 = doc2)
        SELECT start AS owner, fact1 AS old, min(fact1 || '>' || fact2) AS new FROM t GROUP BY ALL""",
    "canonical_probabilities": f"WITH RECURSIVE {_CANONICAL} SELECT from_node, fact_id, direction, round(p, 9) AS p FROM prob",
    "canonical_paths": f"WITH RECURSIVE {_CANONICAL}, {_TWO} SELECT start, count(*) AS n_paths, count(e) AS n_open, count(*) FILTER (doc1 <> doc2) AS n_two_documents FROM two GROUP BY start",
    "canonical_archives": f"""WITH RECURSIVE {_CANONICAL}, {_TWO}, t AS (SELECT DISTINCT start, fact1, fact2 FROM two WHERE doc1 = doc2)
        SELECT start AS owner, fact1 AS old, min(fact1 || '>' || fact2) AS new FROM t GROUP BY ALL""",
    "fair_batch": f"""WITH {_STEPS}, q AS (SELECT DISTINCT doc_id AS query, from_node AS mention, fact_id AS path_id FROM steps),
        t AS (SELECT *, row_number() OVER (PARTITION BY query, mention ORDER BY path_id) AS turn FROM q), u AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY turn, mention) AS place FROM t)
        SELECT query, mention, path_id, turn, place FROM u WHERE place <= 20""",
    "exact_names": f"""
        WITH k AS (SELECT DISTINCT local_id, CASE WHEN type IN ('Other', 'Unknown') OR type IS NULL THEN 'OTHER' ELSE type END AS grp, lower(nfc_normalize({sql_collapse('name')})) AS n FROM local_entities WHERE local_id IS NOT NULL AND name IS NOT NULL),
        f AS (SELECT *, min(local_id) OVER (PARTITION BY grp, n) AS first FROM k WHERE n <> '')
        SELECT first AS left, local_id AS right, grp FROM f WHERE local_id <> first""",
    "explicit_entities": """
        WITH RECURSIVE p AS (SELECT left_local AS a, right_local AS b FROM identities WHERE left_local IS NOT NULL AND right_local IS NOT NULL),
        s AS (SELECT a, b FROM p UNION SELECT b, a FROM p), reach(v, r) AS (SELECT a, a FROM s UNION SELECT s.b, reach.r FROM reach JOIN s ON reach.v = s.a),
        m AS (SELECT v, min(r) AS root FROM reach GROUP BY v),
        c AS (SELECT root, count(DISTINCT local_id) AS n_members, count(DISTINCT name) AS n_names FROM m JOIN local_entities ON local_id = v GROUP BY root)
        SELECT n_members, count(*) AS n_entities, sum(n_names)::BIGINT AS n_names FROM c GROUP BY n_members""",
    "pagerank_suppliers": """
        WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
        s AS (SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e), t AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS p FROM s),
        x(i, query, node, score) AS (
            SELECT 0, r_name, 'r' || r_regionkey, 1.0::DOUBLE FROM region
            UNION ALL
            SELECT i + 1, query, node, sum(score) FROM (
                SELECT x.i, x.query, t.dst AS node, 0.65::DOUBLE * x.score * t.p AS score FROM x JOIN t ON x.node = t.src WHERE x.i < 10
                UNION ALL
                SELECT x.i, x.query, 'r' || r.r_regionkey, x.score * (1 - 0.65::DOUBLE + CASE WHEN x.node IN (SELECT src FROM t) THEN 0 ELSE 0.65::DOUBLE END) FROM x JOIN region r ON r.r_name = x.query WHERE x.i < 10
            ) GROUP BY i, query, node)
        SELECT query, node, round(score, 9) AS score FROM x WHERE i = 10""",
}
