"""References to records that do not exist.

``orphan_references`` checks references whose key may have several columns,
some of them null. References are grouped by the null mask of their key; each
mask is joined on its non-null columns only, under a declared match rule:

* ``simple``: a reference with any null column is never an orphan (SQL's MATCH SIMPLE);
* ``partial``: a reference matches a target that agrees in all its non-null columns
  (MATCH PARTIAL); with every column null it is never an orphan;
* ``full``: a key that is null in part is always an orphan, an all-null one never (MATCH FULL).

With ``live_from`` and ``live_until`` a target counts only while
``live_from <= time < live_until`` (a null bound is open); references without time need
existence only.

Defined results: an empty reference table gives no rows; an empty target table makes every
reference an orphan; repeated references are reported once each by ``dropDuplicates`` on the
caller's columns; extra columns are dropped before the join, so clashing names do no harm.

Shuffle: both tables are read once, whatever the number of masks. Each reference carries its mask
as a join column; targets are written once with one row for every mask, key and disjoint live span (spans
that touch are united), so a reference meets at most one row and a hot target never
multiplies work. A hot reference is on the side that AQE's skew join can split.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import materialize

RULES = ("simple", "partial", "full")


def orphan_references(
    references: DataFrame,
    targets: DataFrame,
    ref_keys: list[str],
    target_keys: list[str],
    carry: list[str],
    rule: str = "simple",
    time: str | None = None,
    live_from: str | None = None,
    live_until: str | None = None,
) -> DataFrame:
    """Rows of ``references`` (columns ``carry``, key columns and ``ref_mask``) that have no target."""
    if rule not in RULES:
        raise ValueError(f"unknown match rule {rule!r}; known: {', '.join(RULES)}")
    if len(ref_keys) != len(target_keys) or not ref_keys:
        raise ValueError("ref_keys and target_keys must have the same, positive length")
    n = len(ref_keys)
    ks = [f"_k{i}" for i in range(n)]
    refs = references.select(
        *[F.col(c).alias(c) for c in carry],
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(ref_keys)],
        (F.col(time).cast("timestamp") if time else F.lit(None).cast("timestamp")).alias("_time"),
    ).withColumn("ref_mask", F.concat(*[F.when(F.col(k).isNotNull(), "1").otherwise("0") for k in ks]))
    refs = refs.where(F.col("ref_mask") != "0" * n)  # an all-null key refers to nothing under every rule
    if rule == "simple":
        refs = refs.where(F.col("ref_mask") == "1" * n)
    masks = ["".join(m) for m in product("10", repeat=n) if "1" in m] if rule == "partial" else ["1" * n]
    spans = live_spans(targets, target_keys, masks, live_from, live_until)
    same = F.col("ref_mask") == F.col("_mask")
    for i in range(n):
        same = same & F.col(f"_k{i}").eqNullSafe(F.col(f"_t{i}"))
    alive = F.col("_time").isNull() | ((F.col("_from") <= F.col("_time")) & (F.col("_until") > F.col("_time")))
    found = refs.join(spans, same & alive, "left_anti")
    return found.select(*carry, *[F.col(f"_k{i}").alias(ref_keys[i]) for i in range(n) if ref_keys[i] not in carry], "ref_mask")


_EVER = ("0001-01-01 00:00:00", "9999-12-31 00:00:00")


def live_spans(targets: DataFrame, keys: list[str], masks: list[str], live_from: str | None, live_until: str | None) -> DataFrame:
    """(_mask, _t0.., _from, _until): disjoint live spans of every key under every mask; absent columns are null.

    A key keeps a row even if it is never live, because references without time need existence only.
    """
    t = [f"_t{i}" for i in range(len(keys))]
    bound = lambda c, open_: F.coalesce(F.col(c).cast("timestamp"), F.lit(open_).cast("timestamp")) if c else F.lit(open_).cast("timestamp")
    live = targets.select(*[F.col(k).alias(x) for k, x in zip(keys, t)], bound(live_from, _EVER[0]).alias("_from"), bound(live_until, _EVER[1]).alias("_until"))
    each = live.withColumn("_mask", F.explode(F.array(*[F.lit(m) for m in masks])))
    each = each.select("_mask", "_from", "_until", *[F.when(F.substring("_mask", i + 1, 1) == "1", F.col(x)).alias(x) for i, x in enumerate(t)])
    for i, x in enumerate(t):  # a target null in a present column matches no reference
        each = each.where((F.substring("_mask", i + 1, 1) == "0") | F.col(x).isNotNull())
    longest = each.groupBy("_mask", *t, "_from").agg(F.max("_until").alias("_until"))
    if live_from is None and live_until is None:
        return materialize(longest, "targets")
    before = Window.partitionBy("_mask", *t).orderBy("_from")
    fresh = F.coalesce(F.col("_from") > F.max("_until").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    islands = longest.withColumn("_fresh", fresh).withColumn("_island", F.sum(F.col("_fresh").cast("int")).over(before))
    return materialize(islands.groupBy("_mask", *t, "_island").agg(F.min("_from").alias("_from"), F.max("_until").alias("_until")).drop("_island"), "targets")


#: Characters with the Unicode property White_Space.
_SPACE = r"[\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]*"
_SPELLED = rf"^{_SPACE}(?:[dD][oO][cC][-_ ]?)?0*([0-9]{{1,19}}){_SPACE}$"


def spelled_id(element: Column) -> Column:
    """The integer a reference spells: optional ``doc`` prefix, separator and leading zeros; null if none."""
    return F.regexp_extract(element, _SPELLED, 1).try_cast("bigint")


def month_of(time: Column) -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM"), F.lit("none"))


def missing_documents(queries: DataFrame, local_entities: DataFrame, documents: DataFrame) -> DataFrame:
    """Orphan document references of queries and local entities: (ref_table, ref_id, doc_id, ref_month)."""
    asked = (
        queries.select(F.lit("queries").alias("ref_table"), F.col("query_id").alias("ref_id"), F.col("asked_at").cast("timestamp").alias("time"), F.explode("supporting_doc_ids").alias("element"))
    )
    held = local_entities.select(F.lit("local_entities").alias("ref_table"), F.col("local_id").alias("ref_id"), F.col("extracted_at").cast("timestamp").alias("time"), F.col("doc_id").alias("element"))
    refs = asked.unionByName(held).select("ref_table", "ref_id", "time", spelled_id(F.col("element")).alias("doc_id")).where("doc_id is not null").distinct()
    refs = refs.withColumn("ref_month", month_of(F.col("time")))
    found = orphan_references(refs, documents, ["doc_id"], ["doc_id"], ["ref_table", "ref_id", "doc_id", "ref_month"], time="time", live_from="loaded_at", live_until="deleted_at")
    return found.select("ref_table", "ref_id", "doc_id", "ref_month").distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references per table and month."""
    return found.groupBy("ref_table", "ref_month").agg(F.count("*").alias("n_orphans"), F.countDistinct("doc_id").alias("n_documents"))
