"""The k most similar vectors for every vector.

An inverted file of coarse centroids with product-quantised residuals:

1. each key keeps its latest row; vectors that are null, short, all zero or hold NaN take no part;
2. coarse centroids (spherical k-means) and residual codebooks are fitted on a hash-chosen sample
   of at most ``SAMPLE_ROWS`` vectors (the only part that is sampled: every vector is indexed and
   every vector is a query);
3. nearby cells are put into groups of bounded expected size; each vector goes to the group of
   its own cell as member and query, and to the groups of its other probed cells as query;
4. inside a group, asymmetric distance tables (query subvector x codeword) give each probed cell's
   shortlist, which is reranked exactly on the full vectors;
5. the shortlists of all groups are merged to the k best a query.

Every query travels with its full vector; what keeps the shuffles small is that keys travel as 64-bit hashes, under a
seed for which no two keys share one, and are put back on the result.

Skew: an over-full cell is divided into chunks by a hash of the key, its queries go to each chunk.
Identical vectors would make a cell quadratic: where more than k + 1 rows share one vector, the
k + 1 smallest keys stand for all in the index (no other member can rank before them), and the
remaining members get their result, the k smallest keys of their own vector, by a join.

Defined results: similarity ties are broken by the smaller hash of the key; repeated rows of a key count
once; a key without usable vector is absent; fewer than k other vectors give fewer neighbours;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import is_small

K = 5
DIM = 64
SAMPLE_ROWS = 131_072
MAX_CELLS = 16_384
PROBES = 6
#: A cell is probed only if its centroid is at most this much less similar than the nearest one.
MARGIN = 0.1
#: The margin takes effect once the nearer cells hold this many expected members.
LEAST_MEMBERS = 40
SUBSPACES = 8
CODEWORDS = 256
SHORTLIST = 24
#: Expected members of a group, the unit of one task.
GROUP_ROWS = 24_000
#: Expected members of a cell beyond which it is divided into chunks.
CELL_ROWS = 6_000
#: Keys with several rows up to which their set is broadcast; beyond it all rows are shuffled by key.
REPEATED_KEYS = 1_000_000
SEED = 11


def latest_vectors(table: DataFrame, key: str = "vector_key", vector: str = "vector", created: str = "created_at") -> DataFrame:
    """(key, vector): the row of latest ``created`` of each key; ties go to the larger vector."""
    newest = table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.struct(F.col(created).alias("t"), F.col(vector).alias("vector"))).alias("m"))
    return newest.select("key", F.col("m.vector").alias("vector"))


def latest_rows(table: DataFrame) -> DataFrame:
    """(key, kid, vector): as ``latest_vectors`` for columns key, vector, created, with a hash that tells all keys apart.

    Only keys with several rows are shuffled; which those are comes from a shuffle of key hashes alone. Two keys under
    one hash show up there as well, and another seed is taken.
    """
    seed = 0
    while True:
        hashed = table.where("key is not null").withColumn("kid", F.xxhash64(F.lit(seed), "key"))
        repeated = hashed.groupBy("kid").agg(F.count("*").alias("n")).where("n > 1").select("kid", F.lit(True).alias("_again"))
        few = is_small(repeated, REPEATED_KEYS)
        marked = hashed.join(F.broadcast(repeated) if few else repeated, "kid", "left")
        shared = marked.where("_again").groupBy("kid").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
        if not shared.limit(1).count():
            break
        seed += 1
    once = marked.where("_again is null").select("key", "kid", "vector")
    newest = latest_vectors(marked.where("_again"), "key", "vector", "created")
    return once.unionByName(newest.withColumn("kid", F.xxhash64(F.lit(seed), "key")))


def usable(vectors: list | pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the usable entries and their positions."""
    good = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim]
    if not good:
        return np.zeros((0, dim), np.float32), np.zeros(0, np.int64)
    x = np.stack([np.asarray(vectors[i], dtype=np.float64) for i in good])
    return _units(x, np.array(good))


def _units(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
    keep = np.isfinite(norm) & (norm > 0)
    return (x[keep] / norm[keep, None]).astype(np.float32), at[keep]


def _arrow_units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``usable``, straight from an Arrow list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    if not len(at):
        return np.zeros((0, dim), np.float32), at
    values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null element becomes NaN
    return _units(values.reshape(-1, dim), at)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool = False) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        order = np.argsort(near, kind="stable")
        cuts = np.flatnonzero(np.diff(near[order])) + 1
        first = np.concatenate([[0], cuts])
        sums[near[order][first]] = np.add.reduceat(x[order], first, axis=0)
        empty = counts == 0
        centres = np.where(empty[:, None], centres, sums / np.maximum(counts, 1)[:, None]).astype(np.float32)
        if empty.any():
            centres[empty] = x[rng.choice(len(x), int(empty.sum()))]
        if spherical:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmax(x[i : i + 4096] @ centres.T - half, axis=1)
    return out


class Index:
    """Coarse centroids, residual codebooks and the grouping of cells; its size depends on the parameters only."""

    def __init__(self, sample: np.ndarray, total: int):
        rng = np.random.default_rng(SEED)
        cells = int(min(MAX_CELLS, max(1, round(math.sqrt(total))), max(1, len(sample) // 8)))
        self.coarse = kmeans(sample, cells, 8, rng, spherical=True)
        near = _nearest(sample, self.coarse)
        residual = sample - self.coarse[near]
        width = sample.shape[1] // SUBSPACES
        fit = residual[rng.permutation(len(residual))[: 64 * CODEWORDS]]
        self.books = [kmeans(np.ascontiguousarray(fit[:, m * width : (m + 1) * width]), CODEWORDS, 6, rng) for m in range(SUBSPACES)]
        expected = np.bincount(near, minlength=len(self.coarse)) * (total / max(1, len(sample)))
        self.expected = expected
        self.chunks = np.maximum(1, np.ceil(expected / CELL_ROWS)).astype(np.int64)
        self.group = np.zeros(len(self.coarse), np.int64)
        self._next = 0
        self._bisect(np.arange(len(self.coarse)), expected)

    def _bisect(self, cells: np.ndarray, expected: np.ndarray) -> None:
        if len(cells) == 1 or expected[cells].sum() <= GROUP_ROWS:
            self.group[cells] = self._next
            self._next += 1
            return
        c = self.coarse[cells] - self.coarse[cells].mean(axis=0)
        axis = np.linalg.svd(c, full_matrices=False)[2][0]
        order = cells[np.argsort(c @ axis, kind="stable")]
        run = np.cumsum(expected[order])
        at = int(np.clip(np.searchsorted(run, run[-1] / 2) + 1, 1, len(order) - 1))
        self._bisect(order[:at], expected)
        self._bisect(order[at:], expected)

    def encode(self, residual: np.ndarray) -> np.ndarray:
        width = residual.shape[1] // SUBSPACES
        return np.stack([_nearest(np.ascontiguousarray(residual[:, m * width : (m + 1) * width]), b) for m, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Asymmetric tables (subspace, query, codeword): inner products of query parts and codewords."""
        width = queries.shape[1] // SUBSPACES
        out = np.zeros((SUBSPACES, len(queries), CODEWORDS), np.float32)
        for m, b in enumerate(self.books):
            out[m, :, : len(b)] = queries[:, m * width : (m + 1) * width] @ b.T
        return out


PLACED = "grp long, member boolean, kid long, vec binary, cell int, chunk int, probes binary"


def _place(index: Index, dim: int, probes: int):
    """Members and queries of each group."""
    types = pa.schema([("grp", pa.int64()), ("member", pa.bool_()), ("kid", pa.int64()), ("vec", pa.binary()), ("cell", pa.int32()), ("chunk", pa.int32()), ("probes", pa.binary())])
    most = int(index.chunks.max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _arrow_units(batch.column("vector"), dim)
            if not len(at):
                continue
            kids = batch.column("kid").take(pa.array(at)).to_numpy()
            hashes = kids & 0x7FFFFFFFFFFFFFFF
            indexed = batch.column("indexed").take(pa.array(at)).to_numpy(zero_copy_only=False)
            p = min(probes, len(index.coarse))
            sims = x @ index.coarse.T
            own = np.argmax(sims, axis=1)
            near = np.argpartition(-sims, p - 1, axis=1)[:, :p] if p < sims.shape[1] else np.argsort(-sims, axis=1)[:, :p]
            near_sims = np.take_along_axis(sims, near, axis=1)
            order = np.argsort(-near_sims, axis=1)
            near, near_sims = np.take_along_axis(near, order, axis=1), np.take_along_axis(near_sims, order, axis=1)
            nearer = np.cumsum(index.expected[near], axis=1) - index.expected[near]
            close = (near_sims >= near_sims[:, :1] - MARGIN) | (nearer < LEAST_MEMBERS)
            rows: list[tuple] = []
            for i, kid in enumerate(kids.tolist()):
                cells = set(near[i][close[i]].tolist())
                cells.add(int(own[i]))
                home = int(own[i])
                chunk = int(hashes[i] % index.chunks[home])
                by: dict[int, list[int]] = {}
                for c in cells:
                    for part in range(int(index.chunks[c])):
                        by.setdefault(int(index.group[c]) * most + part if index.chunks[c] > 1 else int(index.group[c]) * most, []).append(c)
                at_home = int(index.group[home]) * most + (chunk if index.chunks[home] > 1 else 0)
                for grp, mine in by.items():
                    here = grp == at_home and bool(indexed[i])
                    rows.append((grp, here, kid, x[i].tobytes(), home if here else -1, chunk, np.array(sorted(mine), np.int32).tobytes()))
            columns = list(zip(*rows)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

    return run


FOUND = "kid long, near array<long>, sims array<float>"


def _search(index: Index, k: int, shortlist: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("kid", kind="stable")  # ties then go to the smaller hash
        q = np.frombuffer(b"".join(pdf["vec"]), np.float32).reshape(len(pdf), index.coarse.shape[1])
        kids = pdf["kid"].to_numpy()
        members = np.flatnonzero(pdf["member"].to_numpy())
        cell_of = pdf["cell"].to_numpy()[members]
        lens = np.array([len(p) // 4 for p in pdf["probes"]])
        probe_cell = np.frombuffer(b"".join(pdf["probes"]), np.int32)
        probe_row = np.repeat(np.arange(len(pdf)), lens)
        best_s = np.full((len(pdf), k), -np.inf, np.float32)
        best_i = np.full((len(pdf), k), -1, np.int64)
        for cell in np.unique(cell_of):
            inside = members[cell_of == cell]
            asking = probe_row[probe_cell == cell]
            if not len(asking):
                continue
            codes = index.encode(q[inside] - index.coarse[cell]).astype(np.intp)
            step = max(16, 4_000_000 // max(1, len(inside)))
            for a in range(0, len(asking), step):
                rows = asking[a : a + step]
                s, i = _cell_best(index, q, rows, inside, codes, cell, k, shortlist)
                merged_s = np.concatenate([best_s[rows], s], axis=1)
                merged_i = np.concatenate([best_i[rows], i], axis=1)
                order = np.lexsort((merged_i, -merged_s), axis=1)[:, :k]
                best_s[rows] = np.take_along_axis(merged_s, order, axis=1)
                best_i[rows] = np.take_along_axis(merged_i, order, axis=1)
        some = best_i[:, 0] >= 0
        return pd.DataFrame(
            {
                "kid": kids[some],
                "near": [kids[i[i >= 0]] for i in best_i[some]],
                "sims": [s[i >= 0] for s, i in zip(best_s[some], best_i[some])],
            }
        )

    return run


def _cell_best(index: Index, q: np.ndarray, rows: np.ndarray, inside: np.ndarray, codes: np.ndarray, cell: int, k: int, shortlist: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one cell for some queries: table sums pick the shortlist, full vectors rank it."""
    n = len(inside)
    if n > shortlist:
        tables = index.tables(q[rows])
        score = np.take(tables[0], codes[:, 0], axis=1)
        for m in range(1, SUBSPACES):
            score += np.take(tables[m], codes[:, m], axis=1)
        short = np.argpartition(-score, shortlist - 1, axis=1)[:, :shortlist]
    else:
        short = np.broadcast_to(np.arange(n), (len(rows), n))
    ids = inside[short]
    exact = np.einsum("qd,qsd->qs", q[rows], q[ids], optimize=False)
    exact[ids == rows[:, None]] = -np.inf
    ids = np.where(np.isinf(exact), -1, ids)
    order = np.lexsort((ids, -exact), axis=1)[:, :k]
    s, i = np.take_along_axis(exact, order, axis=1), np.take_along_axis(ids, order, axis=1)
    if s.shape[1] < k:
        s = np.pad(s, ((0, 0), (0, k - s.shape[1])), constant_values=-np.inf)
        i = np.pad(i, ((0, 0), (0, k - i.shape[1])), constant_values=-1)
    return s, i


def _is_usable(dim: int):
    return (F.size("vector") == dim) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v)) & F.exists("vector", lambda v: v != 0)


def _crowded(table: DataFrame, k: int, dim: int) -> DataFrame:
    """Hashes of usable vectors that stand in more than k + 1 rows (a superset of the crowded classes)."""
    return table.where("vector is not null").where(_is_usable(dim)).groupBy(F.xxhash64("vector").alias("vh")).agg(F.count("*").alias("n")).where(F.col("n") > k + 1)


def _search_all(table: DataFrame, key: str, vector: str, created: str, k: int, dim: int, probes: int, shortlist: int) -> tuple[DataFrame, DataFrame]:
    """(kid, nid, similarity, rank) of every usable vector, and (kid, key) of all."""
    narrow = table.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(created).alias("created"))
    latest = latest_rows(narrow)
    total = narrow.count()
    index = Index(_sample(narrow, total, dim), total)
    crowded = _crowded(narrow, k, dim)
    direct = None
    if crowded.limit(1).count():
        alike = latest.where(_is_usable(dim)).withColumn("vh", F.xxhash64("vector"))
        among = alike.select("vh", "key", "kid").join(crowded.select("vh"), "vh", "left_semi")
        # the rank limit is applied in every map task first, so a crowded class sends k + 1 rows a task
        top = among.withColumn("r", F.row_number().over(Window.partitionBy("vh").orderBy("key"))).where(F.col("r") <= k + 1)
        first = top.groupBy("vh").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "kid"))), lambda x: x["kid"]).alias("first"))  # k + 1 rows a class
        split = alike.join(first, "vh", "left").withColumn("indexed", F.col("first").isNull() | F.array_contains("first", F.col("kid")))
        direct = split.where("not indexed").select("kid", F.posexplode(F.slice("first", 1, k)).alias("pos", "nid"))
        direct = direct.select("kid", "nid", F.lit(1.0).alias("similarity"), (F.col("pos") + 1).alias("rank"))
        source = split.where("indexed").select("kid", "vector", "indexed")
    else:
        source = latest.select("kid", "vector", F.lit(True).alias("indexed"))
    placed = source.mapInArrow(_place(index, dim, probes), PLACED)
    found = placed.groupBy("grp").applyInPandas(_search(index, k, shortlist), FOUND)
    best = F.slice(
        F.array_sort(
            F.flatten(F.collect_list(F.arrays_zip(F.col("sims").alias("sims"), F.col("near").alias("near")))),
            lambda a, b: F.when(a["sims"] > b["sims"], -1).when(a["sims"] < b["sims"], 1).when(a["near"] < b["near"], -1).when(a["near"] > b["near"], 1).otherwise(0),
        ),
        1,
        k,
    )
    merged = found.groupBy("kid").agg(best.alias("best")).select("kid", F.posexplode("best").alias("pos", "b"))
    out = merged.select("kid", F.col("b.near").alias("nid"), F.col("b.sims").cast("double").alias("similarity"), (F.col("pos") + 1).alias("rank"))
    return out if direct is None else out.unionByName(direct), latest.select("kid", "key")


def _named(rows: DataFrame, keys: DataFrame, hashed: str, name: str) -> DataFrame:
    return rows.join(keys.select(F.col("kid").alias(hashed), F.col("key").alias(name)), hashed).drop(hashed)


def nearest_neighbours(table: DataFrame, key: str = "vector_key", vector: str = "vector", created: str = "created_at", k: int = K, dim: int = DIM, probes: int = PROBES, shortlist: int = SHORTLIST) -> DataFrame:
    """(key, neighbour, similarity, rank): the k most similar other keys of every usable key."""
    found, keys = _search_all(table, key, vector, created, k, dim, probes, shortlist)
    return _named(_named(found, keys, "kid", "key"), keys, "nid", "neighbour").select("key", "neighbour", "similarity", "rank")


def neighbour_pairs(table: DataFrame, key: str = "vector_key", vector: str = "vector", created: str = "created_at", k: int = K, dim: int = DIM, probes: int = PROBES, shortlist: int = SHORTLIST) -> DataFrame:
    """(vector_key_a, vector_key_b): unordered pairs in which at least one key is among the other's nearest."""
    found, keys = _search_all(table, key, vector, created, k, dim, probes, shortlist)
    pairs = found.select(F.least("kid", "nid").alias("x"), F.greatest("kid", "nid").alias("y")).distinct()
    named = _named(_named(pairs, keys, "x", "kx"), keys, "y", "ky")
    return named.select(F.least("kx", "ky").alias("vector_key_a"), F.greatest("kx", "ky").alias("vector_key_b"))


def _sample(narrow: DataFrame, total: int, dim: int) -> np.ndarray:
    """Unit vectors of a hash-chosen sample of at most SAMPLE_ROWS rows, for fitting the index."""
    want = min(SAMPLE_ROWS, max(4_096, 40 * int(math.sqrt(max(1, total)))))
    share = min(1.0, want / max(1, total))
    chosen = narrow.where(F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).select("vector").limit(SAMPLE_ROWS)
    rows = chosen.toArrow().column("vector")
    x, _ = _arrow_units(rows, dim)
    if not len(x):
        x = np.eye(1, dim, dtype=np.float32)
    return x
