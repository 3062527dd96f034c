"""Queries over vector search, passage ranking, question linking and the metrics on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import norm
from quillgraph.operators import answers as A
from quillgraph.operators import graph as G
from quillgraph.operators import identity as I
from quillgraph.operators import retrieval as R
from quillgraph.operators import search as S
from quillgraph.operators import walks as W
from quillgraph.operators.references import spelled_id
from quillgraph.plans.graph import PRIORITY, canonical_steps
from quillgraph.plans.text import SQL_SPACE, sql_answer
from quillgraph.session import discard, materialize, read_table

CANDIDATES, TOP = 100, 5
KS = (2, 5, 10, 20)
#: Walk steps of fact_ppr; the SQL beside it takes as many.
PPR_STEPS = 6


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stated query set (every vector whose id is divisible by 100) and all vectors."""
    e = read_table(spark, sf_dir, "embeddings")
    base = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv")), base


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, base = _vectors(spark, sf_dir)
    return R.top_k(q, base, 20).select("query", "id", F.round("score", 6).alias("score"), "rank")


def entity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, base = _vectors(spark, sf_dir)
    return R.above(R.top_k(q, base, 10), 0.2).select("query", "id", F.round("score", 6).alias("score"), "rank")


def dense_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as passages, each by its best vector among the candidates."""
    q, base = _vectors(spark, sf_dir)
    found = R.passages(R.top_k(q, base, CANDIDATES), base.select("id", F.col("label").alias("passage")), TOP)
    return found.select("query", "passage", F.round("score", 6).alias("score"), "best_fact", "rank")


def relation_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, base = _vectors(spark, sf_dir)
    rated = R.relation_priority(base.select(F.col("id").alias("relation"), "v"), q.select(F.col("query").alias("hint"), "qv"), 0.3)
    return rated.select("relation", F.round("score", 6).alias("score"), "selected")


def ppr_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restart vectors: the 20 best vectors of each query as facts, labels over 0.2 as entities."""
    q, base = _vectors(spark, sf_dir)
    return _seeds(q, base).select("query", "node", F.round("p", 9).alias("p"))


def _seeds(q: DataFrame, base: DataFrame) -> DataFrame:
    facts = R.top_k(q, base, 20).select("query", F.lit("fact").alias("kind"), F.concat(F.lit("v"), "id").alias("node"), "score")
    entities = R.above(R.top_k(q, base, 10), 0.2).join(base.select("id", "label"), "id").groupBy("query", "label").agg(F.max("score").alias("score"))
    return G.seed_vector(facts.unionByName(entities.select("query", F.lit("entity").alias("kind"), F.concat(F.lit("l"), "label").alias("node"), "score")))


def ppr_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five passages a query by restarted walks on the vector and label graph, each by its best vector."""
    q, base = _vectors(spark, sf_dir)
    edges = G.symmetric(base.select(F.concat(F.lit("v"), "id").alias("a"), F.concat(F.lit("l"), "label").alias("b")), "a", "b")
    rank = G.personalised_pagerank(edges, _seeds(q, base), alpha=0.65, iterations=10)
    facts = rank.where("node like 'v%'").join(base.select(F.concat(F.lit("v"), "id").alias("node"), F.col("label").alias("passage")), "node")
    best = facts.groupBy("query", "passage").agg(F.max(F.round("score", 9)).alias("score"))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("passage"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of the stated set: those whose number is divisible by 100."""
    return read_table(spark, sf_dir, "queries").where(F.regexp_extract("query_id", "([0-9]+)$", 1).try_cast("bigint") % 100 == 0)


def fact_ppr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by restarted walks over the graph of facts and records, from the records a question mentions, each with its best fact.

    Records of one normalised name and type are one node, so the walk passes from article to article.
    """
    le = read_table(spark, sf_dir, "local_entities").where("local_id is not null and name is not null").select("local_id", "type", "name")
    known = le.groupBy("local_id").agg(F.min(F.struct(F.coalesce("type", F.lit("")).alias("type"), norm(F.col("name")).alias("name"))).alias("x")).select("local_id", "x.*")
    known = materialize(known, "known")
    nodes = materialize(known.select("type", "name").distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    node = materialize(known.join(nodes, ["type", "name"]).select("local_id", "node"), "node_of")
    discard(known)
    discard(nodes)
    facts = read_table(spark, sf_dir, "facts").where("fact_id is not null")
    each = facts.select("fact_id", "doc_id", F.explode_outer(F.array_compact(F.array("subject_local", "object_local"))).alias("local_id")).join(node, "local_id", "left")
    # a fact has two ends and one article, more only if its id was given to different facts
    told = each.groupBy(F.col("fact_id").alias("fact")).agg(F.collect_set(F.struct("doc_id")).alias("docs"), F.array_sort(F.collect_set("node")).alias("ends"))
    told = materialize(told.where("size(ends) > 0").select("fact", F.col("docs.doc_id").alias("docs"), "ends"), "facts")
    kinds = materialize(G.fact_kinds(told), "kinds")
    # the names of a node, each once, meet the questions; not its records
    names = materialize(le.join(node, "local_id").select(F.col("node").alias("local_id"), "name").distinct(), "names")
    seeds = W.question_mentions(_asked(spark, sf_dir), names).select(F.col("query_id").alias("query"), F.lit("entity").alias("kind"), F.col("local_id").alias("node"), F.lit(1.0).alias("score")).distinct()
    seeds = materialize(G.seed_vector(seeds), "seeds")
    numbers = materialize(seeds.select("query").distinct().withColumn("number", F.monotonically_increasing_id()), "numbers")
    seeds = seeds.join(numbers, "query").select(F.col("number").alias("query"), "node", "p")
    scores = G.scores_per_fact(kinds, seeds, alpha=0.65, iterations=PPR_STEPS)
    ranked = G.rank_fact_passages(scores, kinds, told, TOP)
    return ranked.withColumnRenamed("query", "number").join(numbers, "number").select("query", "passage", "score", "best_fact", "rank")


def question_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.question_mentions(read_table(spark, sf_dir, "queries"), read_table(spark, sf_dir, "local_entities"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.ranked_documents(question_mentions(spark, sf_dir), read_table(spark, sf_dir, "local_entities"), 20)


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read_table(spark, sf_dir, "queries").select("query_id", F.explode("supporting_doc_ids").alias("e"))
    return q.select(F.col("query_id").alias("query"), spelled_id(F.col("e")).alias("doc")).where("doc is not null").distinct()


def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)


def recall_hit_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.retrieval_metrics(_ranked(spark, sf_dir), _gold(spark, sf_dir), KS)
    return m.select("k", *[F.round(c, 9).alias(c) for c in ("recall", "hit", "mrr", "complete")], "n")


def evidence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = read_table(spark, sf_dir, "queries").select(F.col("query_id").alias("query"))
    m = A.evidence_report(selected, _ranked(spark, sf_dir).where(F.col("rank") <= TOP), _gold(spark, sf_dir))
    return m.select("n_selected", "n_finished", F.round("recall", 9).alias("recall"), F.round("complete_evidence", 9).alias("complete_evidence"))


def frontier_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, base = _vectors(spark, sf_dir)
    top = R.top_k(q, base, 50).withColumn("exact", F.col("query") == F.col("id"))
    return W.frontier_priors(top).select("query", "id", F.round("prior", 6).alias("prior"))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per question its answers and, as prediction, the title of its first supporting fact."""
    q = read_table(spark, sf_dir, "queries").select("query_id", "answers", F.col("supporting_facts.title").alias("titles")).distinct()
    return q.select("query_id", F.get("titles", F.lit(0)).alias("prediction"), F.filter("answers", lambda a: a.isNotNull()).alias("answers"))


def qa_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predicted(spark, sf_dir).where("size(answers) > 0").withColumn("prediction", F.coalesce("prediction", F.lit("")))
    return p.select("query_id", "prediction", A.exact_match(F.col("prediction"), F.col("answers")).alias("em"), F.round(A.token_f1(F.col("prediction"), F.col("answers")), 9).alias("f1"), F.size("answers").alias("n_answers"))


def qa_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.answer_report(_predicted(spark, sf_dir))
    return r.select("n", F.round("exact_match", 9).alias("exact_match"), F.round("token_f1", 9).alias("token_f1"), "n_unknown")


def start_nodes(mentions: DataFrame, known: DataFrame, most: int = 50) -> DataFrame:
    """(query, mention, node, prior, rank): at most ``most`` canonical nodes of a mention, those with most records of the name first."""
    return asked_nodes(mentions.select("query_id", "mention").distinct(), mentions.select("mention", "local_id").distinct(), known, most)


def asked_nodes(asked: DataFrame, bearers: DataFrame, known: DataFrame, most: int = 50) -> DataFrame:
    """As ``start_nodes`` for ``asked(query_id, mention)`` and ``bearers(mention, local_id)``, each row once.

    Names match in full, so the records that bear the name are what tells two nodes apart. Records are
    counted per mention before questions are joined, as many questions hold a hot name: questions and records of it never meet.
    """
    nodes = bearers.join(known.select("local_id", "entity_id"), "local_id", "left").groupBy("mention", F.coalesce("entity_id", "local_id").alias("node")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy("mention").orderBy(F.col("_n").desc(), "node")
    ranked = nodes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return asked.select(F.col("query_id").alias("query"), "mention").join(ranked, "mention").select("query", "mention", "node", F.lit(1.0).alias("prior"), "rank")


def question_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the budgeted evidence search selects for every question, from the canonical nodes it mentions."""
    known = materialize(I.explicit_mapping(read_table(spark, sf_dir, "identities")), "known")
    le = read_table(spark, sf_dir, "local_entities")
    names = materialize(W.record_names(le), "names")
    asked = materialize(W.question_runs(read_table(spark, sf_dir, "queries"), le).join(names.select("mention").distinct(), "mention", "left_semi"), "asked")
    bearers = names.join(asked.select("mention").distinct(), "mention", "left_semi")
    starts = materialize(asked_nodes(asked, bearers, known), "starts")
    for df in (names, asked):
        discard(df)
    return S.select_documents(S.search(starts, canonical_steps(spark, sf_dir, known), S.priority_checker([f"X {r} Y" for r in PRIORITY])))


QUERIES = {
    f.__name__: f
    for f in (dense_topk, entity_topk, dense_passages, relation_priority, ppr_seeds, ppr_passages, fact_ppr, question_mentions, linked_documents, recall_hit_mrr, evidence_metrics, frontier_priors, qa_scores, qa_report, question_search)
}

_PAIRS = """p AS (SELECT q.vec_id AS query, b.vec_id AS id, b.label, list_inner_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings b WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM p)"""
_SEEDS = f"""{_PAIRS}, kinds AS (
        SELECT query, 'fact' AS kind, 'v' || id AS node, greatest(s, 0) AS s FROM r WHERE rank <= 20
        UNION ALL SELECT query, 'entity', 'l' || label, greatest(max(s), 0) FROM r WHERE rank <= 10 AND s >= 0.2 GROUP BY query, label),
    w AS (SELECT *, sum(s) OVER (PARTITION BY query, kind) AS t, count(*) OVER (PARTITION BY query, kind) AS n, count(DISTINCT kind) OVER (PARTITION BY query) AS k FROM kinds),
    mixed AS (SELECT query, node, sum(CASE WHEN t > 0 THEN s / t ELSE 1.0 / n END * CASE WHEN k < 2 THEN 1 WHEN kind = 'fact' THEN 0.8 ELSE 0.2 END) AS p FROM w GROUP BY ALL),
    seeds AS (SELECT query, node, p / sum(p) OVER (PARTITION BY query) AS p FROM mixed)"""
def _sql_words(c: str) -> str:
    return "list_filter(string_split_regex(lower(nfc_normalize(" + c + r")), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _sql_norm(c: str) -> str:
    return f"trim(regexp_replace(lower(nfc_normalize({c})), '{SQL_SPACE}+', ' ', 'g'))"


_MENTIONS = f"""q AS (SELECT DISTINCT query_id, {_sql_words('question')} AS w FROM queries WHERE question IS NOT NULL),
    n AS (SELECT DISTINCT local_id, array_to_string({_sql_words('name')}, ' ') AS mention FROM local_entities WHERE local_id IS NOT NULL AND name IS NOT NULL),
    runs AS (SELECT DISTINCT query_id, array_to_string(w[i:i + l - 1], ' ') AS mention FROM (SELECT query_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM (SELECT query_id, w, unnest(range(1, len(w) + 1)) AS l FROM q) WHERE l <= len(w))),
    m AS (SELECT query_id, local_id, mention FROM runs JOIN n USING (mention) WHERE mention <> '')"""
_RANKED = f"""{_MENTIONS}, d AS (SELECT DISTINCT local_id, try_cast(doc_id AS BIGINT) AS doc FROM local_entities WHERE try_cast(doc_id AS BIGINT) IS NOT NULL),
    per AS (SELECT query_id AS query, doc, count(DISTINCT mention) AS score, max(length(mention)) AS longest FROM m JOIN d USING (local_id) GROUP BY ALL),
    ranked AS (SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, longest DESC, doc) AS rank FROM per) WHERE rank <= 20),
    gold AS (SELECT DISTINCT query, doc FROM (SELECT query_id AS query, try_cast(nullif(regexp_extract(e, '^{SQL_SPACE}*(?:[dD][oO][cC][-_ ]?)?0*([0-9]{{1,19}}){SQL_SPACE}*$', 1), '') AS bigint) AS doc FROM (SELECT query_id, unnest(supporting_doc_ids) AS e FROM queries)) WHERE doc IS NOT NULL)"""
_PREDICTED = """pr AS (SELECT query_id, coalesce(t[1], '') AS prediction, list_filter(answers, lambda a: a IS NOT NULL) AS answers FROM (SELECT DISTINCT query_id, answers, list_transform(supporting_facts, lambda x: x.title) AS t FROM queries)),
    u AS (SELECT row_number() OVER () AS rid, * FROM pr WHERE len(answers) > 0),
    x AS (SELECT rid, query_id, prediction, len(answers) AS n_answers, unnest(answers) AS a FROM u),
    k AS (SELECT *, """ + sql_answer("prediction") + " AS p, " + sql_answer("a") + """ AS g FROM x),
    c AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda y: y = t)), len(list_filter(g, lambda y: y = t))))), 0) AS common FROM k),
    s AS (SELECT rid, query_id, prediction, n_answers, CASE WHEN array_to_string(p, ' ') = array_to_string(g, ' ') THEN 1.0 ELSE 0.0 END AS em,
        CASE WHEN (array_to_string(p, ' ') IN ('yes', 'no', 'noanswer') OR array_to_string(g, ' ') IN ('yes', 'no', 'noanswer')) AND array_to_string(p, ' ') <> array_to_string(g, ' ') THEN 0.0
            WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN len(p) = 0 OR len(g) = 0 OR common = 0 THEN 0.0 ELSE 2.0::DOUBLE * common / (len(p) + len(g)) END AS f1 FROM c),
    b AS (SELECT rid, query_id, prediction, n_answers, max(em)::DOUBLE AS em, max(f1)::DOUBLE AS f1 FROM s GROUP BY ALL)"""

ORACLE_SQL = {
    "dense_topk": f"WITH {_PAIRS} SELECT query, id, round(s, 6) AS score, rank FROM r WHERE rank <= 20",
    "entity_topk": f"WITH {_PAIRS} SELECT query, id, round(s, 6) AS score, rank FROM r WHERE rank <= 10 AND s >= 0.2",
    "dense_passages": f"""WITH {_PAIRS}, b AS (SELECT query, label AS passage, max(s) AS score, first(id ORDER BY s DESC, rank) AS best_fact FROM r WHERE rank <= {CANDIDATES} GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, passage) AS rank FROM b) SELECT query, passage, round(score, 6) AS score, best_fact, rank FROM o WHERE rank <= {TOP}""",
    "relation_priority": f"WITH {_PAIRS} SELECT id AS relation, round(max(s), 6) AS score, max(s) >= 0.3 AS selected FROM p GROUP BY id",
    "ppr_seeds": f"WITH {_SEEDS} SELECT query, node, round(p, 9) AS p FROM seeds WHERE p > 0",
    "ppr_passages": f"""WITH RECURSIVE {_SEEDS}, e AS (SELECT 'v' || vec_id AS a, 'l' || label AS b FROM embeddings), sy AS (SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e),
        t AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM sy),
        x(i, query, node, score) AS (
            SELECT 0, query, node, p::DOUBLE FROM seeds
            UNION ALL
            SELECT i + 1, query, node, sum(score) FROM (
                SELECT x.i, x.query, t.dst AS node, 0.65::DOUBLE * x.score * t.w AS score FROM x JOIN t ON x.node = t.src WHERE x.i < 10
                UNION ALL
                SELECT x.i, x.query, d.node, x.mass * 0.35::DOUBLE * d.p FROM (SELECT i, query, sum(score) AS mass FROM x WHERE i < 10 GROUP BY ALL) x JOIN seeds d ON d.query = x.query
            ) GROUP BY i, query, node),
        b AS (SELECT query, label AS passage, max(round(score, 9)) AS score FROM x JOIN embeddings ON node = 'v' || vec_id WHERE i = 10 GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, passage) AS rank FROM b) SELECT query, passage, score, rank FROM o WHERE rank <= {TOP}""",
    "fact_ppr": f"""WITH RECURSIVE {_MENTIONS},
        node AS (SELECT local_id, 'e:' || x.type || ':' || x.name AS node FROM (SELECT local_id, min({{'type': coalesce(type, ''), 'name': {_sql_norm('name')}}}) AS x FROM local_entities WHERE local_id IS NOT NULL AND name IS NOT NULL GROUP BY 1)),
        fa AS (SELECT DISTINCT fact_id, doc_id, subject_local, object_local FROM facts),
        e AS (SELECT DISTINCT 'f:' || fact_id AS f, node FROM (SELECT fact_id, unnest([subject_local, object_local]) AS local_id FROM fa) JOIN node USING (local_id)),
        sy AS (SELECT f AS src, node AS dst FROM e UNION SELECT node, f FROM e),
        t AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM sy),
        sn AS (SELECT DISTINCT query_id AS query, node FROM m JOIN node USING (local_id) WHERE try_cast(regexp_extract(query_id, '([0-9]+)$', 1) AS BIGINT) % 100 = 0),
        seeds AS (SELECT query, node, 1.0::DOUBLE / count(*) OVER (PARTITION BY query) AS p FROM sn),
        x(i, query, node, score) AS (
            SELECT 0, query, node, p FROM seeds
            UNION ALL
            SELECT i + 1, query, node, sum(score) FROM (
                SELECT x.i, x.query, t.dst AS node, 0.65::DOUBLE * x.score * t.w AS score FROM x JOIN t ON x.node = t.src WHERE x.i < {PPR_STEPS}
                UNION ALL
                SELECT x.i, x.query, x.node, 0.0 FROM x WHERE false
                UNION ALL
                SELECT x.i, x.query, d.node, (x.mass * 0.35::DOUBLE + 0.65::DOUBLE * x.lost) * d.p FROM (SELECT i, query, sum(score) AS mass, coalesce(sum(score) FILTER (node NOT IN (SELECT src FROM t)), 0) AS lost FROM x WHERE i < {PPR_STEPS} GROUP BY ALL) x JOIN seeds d ON d.query = x.query
            ) GROUP BY i, query, node),
        b AS (SELECT query, doc_id AS passage, max(round(score, 9)) AS score, first(fact_id ORDER BY round(score, 9) DESC, fact_id) AS best_fact FROM x JOIN fa ON node = 'f:' || fact_id WHERE i = {PPR_STEPS} GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, passage) AS rank FROM b) SELECT query, passage, score, best_fact, rank FROM o WHERE rank <= {TOP}""",
    "question_mentions": f"WITH {_MENTIONS} SELECT query_id, local_id, mention FROM m",
    "linked_documents": f"WITH {_RANKED} SELECT query, doc, score, rank FROM ranked",
    "recall_hit_mrr": f"""WITH {_RANKED}, h AS (SELECT g.query, g.doc, r.rank, k FROM gold g LEFT JOIN ranked r ON g.query = r.query AND g.doc = r.doc, (SELECT unnest([2, 5, 10, 20]) AS k)),
        q1 AS (SELECT query, k, count(*) AS g, count(*) FILTER (rank <= k) AS f, min(rank) FILTER (rank <= k) AS first FROM h GROUP BY ALL)
        SELECT k, round(avg(f / g), 9) AS recall, round(avg((f > 0)::INT), 9) AS hit, round(avg(coalesce(1 / first, 0)), 9) AS mrr, round(avg((f = g)::INT), 9) AS complete, count(*) AS n FROM q1 GROUP BY k""",
    "evidence_metrics": f"""WITH {_RANKED}, sel AS (SELECT DISTINCT query_id AS query FROM queries), top AS (SELECT * FROM ranked WHERE rank <= {TOP}),
        f AS (SELECT g.query, count(*) AS g, count(t.doc) AS f FROM gold g LEFT JOIN top t ON g.query = t.query AND g.doc = t.doc GROUP BY 1)
        SELECT count(*) AS n_selected, count(*) FILTER (s.query IN (SELECT query FROM top)) AS n_finished, round(avg(f / g), 9) AS recall, round(avg(coalesce((f = g)::INT, 0)), 9) AS complete_evidence FROM sel s LEFT JOIN f ON f.query = s.query""",
    "frontier_priors": f"""WITH {_PAIRS}, t AS (SELECT *, exp((s - max(s) OVER (PARTITION BY query)) / 0.1::DOUBLE) AS b FROM r WHERE rank <= 50)
        SELECT query, id, round(CASE WHEN query = id THEN greatest(b, 1.0) ELSE b END, 6) AS prior FROM t""",
    "qa_scores": f"WITH {_PREDICTED} SELECT query_id, prediction, em, round(f1, 9) AS f1, n_answers FROM b",
    "qa_report": f"WITH {_PREDICTED} SELECT count(*) AS n, round(avg(em), 9) AS exact_match, round(avg(f1), 9) AS token_f1, count(*) FILTER (lower(prediction) IN ('', 'unknown')) AS n_unknown FROM b",
}
