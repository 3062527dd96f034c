"""Near-duplicate texts by pigeonring filtering of minwise signatures.

A text is the set of its runs of consecutive words. Its signature has one minimum for each of
``segments x rows`` hash functions; two texts of similarity t differ in about (1 - t) of the
positions, so "similarity at least t" becomes "Hamming distance at most tau" between signatures, with
tau set ``SLACK`` standard deviations above the expectation at the threshold. The positions form a
ring of segments of ``rows`` positions. If two signatures are within tau, some segment starts a
chain whose first l segments together differ in at most l * tau / segments positions, for every l:

1. a pair is met at every segment that differs within the budget of a chain of one: with
   d = floor(tau / segments), a segment is posted once for every choice of d positions left out, under the
   positions kept, so segments that differ in up to d positions share a key;
2. in that join the chain of ``CHAIN`` segments from there on must stay within its proportional budgets;
   its positions travel with the key as four bits each, in one long;
3. survivors get the full Hamming check over all positions, then the exact similarity of the two
   texts decides.

Steps 1 and 2 lose no pair within tau. A pair of the threshold's similarity lies beyond tau only by chance of its
signature: about 0.13 % at similarity exactly 0.5, under 0.01 % at 0.55.

Exact copies (equal sets) are collapsed to one representative first, so a text copied into a third
of all rows costs one signature. ``document_pairs`` writes out the copies of small classes (up to
``expand_copies``, None for all); in a larger class each member is paired with its
representative, the smallest id, and the representative stands for the class in pairs with others;
``membership`` names the class of every document with its copies and links.

Defined results: null texts and texts with fewer words than a run are in no pair and no class;
repeated rows of one id count once; very long texts are hashed in slices; an empty table gives an
empty result; extra columns are ignored.

Shuffles: one key row of 24 bytes for each posting of a distinct text; texts travel only for surviving
candidates. No bucket is ever collected: hot keys are streamed by the sort-merge join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.words import Hasher, runs
from quillgraph.session import is_small, materialize

SHINGLE = 5
THRESHOLD = 0.8
SEGMENTS = 32
ROWS = 3
#: Segments of a chain, its first one included; their positions fill one long.
CHAIN = 5
SLACK = 3.0
#: Size of a copy class up to which all its pairs are written out by default.
EXPAND_COPIES = 64
#: Ids (one long each) up to which a set of ids is broadcast; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
SEED = 3
_NIBBLES = 0x1111111111111111

_POSITIONS = SEGMENTS * ROWS
_LONGS = _POSITIONS * 4 // 64
SIGNED = "doc_id bigint, n int, s1 bigint, s2 bigint, minima binary, " + ", ".join(f"g{i} bigint" for i in range(_LONGS))


def budget(threshold: float, positions: int = _POSITIONS) -> float:
    """Hamming budget tau of the four-bit signature for a similarity threshold."""
    same = threshold + (1 - threshold) / 16
    return positions * (1 - same) + SLACK * math.sqrt(positions * same * (1 - same))


def shingles(ids: np.ndarray, n: int) -> np.ndarray:
    return np.unique(runs(ids, n))


_FACTORS = (np.random.default_rng(SEED).integers(1, 2**63, _POSITIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def minima(s: np.ndarray) -> np.ndarray:
    """One 32-bit minimum per hash function over a set of shingle hashes."""
    best = np.full(_POSITIONS, 0xFFFFFFFF, np.uint64)
    step = 4096
    for a in range(0, len(s), step):
        np.minimum(best, ((s[None, a : a + step] * _FACTORS[:, None]) >> np.uint64(32)).min(axis=1), out=best)
    return best


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sign(shingle: int):
    names = [f.split()[0] for f in SIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            ids, n, s1, s2, mins = [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                s = shingles(hasher.ids(text), shingle)
                if not len(s):
                    continue
                ids.append(doc_id)
                n.append(len(s))
                s1.append(s.sum(dtype=np.uint64))
                s2.append(_scramble(s).sum(dtype=np.uint64))
                mins.append(minima(s))
            if not ids:
                continue
            m = np.stack(mins)
            short = (_scramble(m) >> np.uint64(20)).astype(np.uint16)  # sixteen bits of each minimum, the lowest four for Hamming checks
            nibbles = (short & np.uint16(15)).astype(np.uint64)
            packed = (nibbles.reshape(len(ids), _LONGS, 16) << (np.uint64(4) * np.arange(16, dtype=np.uint64))).sum(axis=2, dtype=np.uint64).view(np.int64)
            columns = [
                pa.array(ids, pa.int64()),
                pa.array(n, pa.int32()),
                pa.array(np.array(s1, np.uint64).view(np.int64)),
                pa.array(np.array(s2, np.uint64).view(np.int64)),
                pa.array([b.tobytes() for b in short], pa.binary()),
                *[pa.array(np.ascontiguousarray(packed[:, i])) for i in range(_LONGS)],
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def signatures(documents: DataFrame, shingle: int) -> DataFrame:
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return rows.mapInArrow(_sign(shingle), SIGNED)


def first_budget(tau: float) -> int:
    """Positions in which the first segment of a chain may differ."""
    return min(ROWS - 1, math.floor(tau / SEGMENTS))


def _postings(tau: float):
    """(key, doc, chain) per segment and choice of kept positions: slot and positions kept, and the four-bit positions of the chain."""
    kept = list(combinations(range(ROWS), ROWS - first_budget(tau)))
    shift = np.uint64(4) * np.arange(CHAIN * ROWS, dtype=np.uint64)
    ring = (ROWS * np.arange(SEGMENTS)[:, None] + np.arange(CHAIN * ROWS)[None, :]) % _POSITIONS
    slot = np.arange(SEGMENTS * len(kept), dtype=np.int64).reshape(SEGMENTS, len(kept)) << 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column("doc_id").to_numpy()
            minima = np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.uint16).reshape(-1, _POSITIONS).astype(np.uint64)
            for a in range(0, len(doc), 2_000):
                part = minima[a : a + 2_000]
                chain = ((part[:, ring] & np.uint64(15)) << shift).sum(axis=2, dtype=np.uint64).view(np.int64)
                seg = part.reshape(-1, SEGMENTS, ROWS)
                keys = np.empty((len(part), SEGMENTS, len(kept)), np.int64)
                for c, positions in enumerate(kept):
                    h = seg[:, :, positions[0]]
                    for r in positions[1:]:
                        h = (h << np.uint64(16)) | seg[:, :, r]
                    keys[:, :, c] = slot[:, c] | ((_scramble(h + np.uint64(1)) >> np.uint64(32)).astype(np.int64) if len(positions) > 2 else h.astype(np.int64))
                each = SEGMENTS * len(kept)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(doc[a : a + 2_000], each)), pa.array(np.repeat(chain.ravel(), len(kept)))], names=["key", "doc", "chain"]
                )

    return run


def _differing(a: Column, b: Column) -> Column:
    """A long with the lowest bit of each four-bit position set where two packed longs differ."""
    x = a.bitwiseXOR(b)
    spread = x
    for i in (1, 2, 3):
        spread = spread.bitwiseOR(F.shiftrightunsigned(x, i))
    return spread.bitwiseAND(F.lit(_NIBBLES))


def _chain_within(a: Column, b: Column, tau: float) -> Column:
    differ = _differing(a, b)
    ok = F.lit(True)
    for length in range(1, CHAIN + 1):
        allowed = math.floor(length * tau / SEGMENTS)
        if allowed < length * ROWS:
            ok = ok & (F.bit_count(differ.bitwiseAND(F.lit((1 << (4 * length * ROWS)) - 1))) <= allowed)
    return ok


def _where_in(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join on doc_id, broadcasting the ids only when their number was checked."""
    return rows.join(F.broadcast(ids) if is_small(ids, BROADCAST_IDS) else ids, "doc_id", how)


def _verify(shingle: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            a_ids, b_ids = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            out = []
            for a, b, ta, tb in zip(a_ids, b_ids, batch.column("ta"), batch.column("tb")):
                if a not in known:
                    known[a] = shingles(hasher.ids(ta.as_py()), shingle)
                if b not in known:
                    known[b] = shingles(hasher.ids(tb.as_py()), shingle)
                x, y = known[a], known[b]
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                union = len(both) - common
                if common >= threshold * union:
                    out.append((a, b, common / union))
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["a", "b", "similarity"])

    return run


class NearDuplicates:
    """Similar pairs of representatives and the copies behind each representative."""

    def __init__(self, documents: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD):
        self.shingle, self.threshold = shingle, threshold
        texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
        signed = materialize(signatures(documents, shingle), "signatures")
        self.classes = signed.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("size"))
        repeated = self.classes.where("size > 1").select("s1", "s2", "n", "rep", "size")
        repeated = F.broadcast(repeated) if is_small(repeated, BROADCAST_IDS) else repeated
        #: (doc_id, rep, size) of documents in copy classes of two or more.
        self.copies = materialize(signed.join(repeated, ["s1", "s2", "n"]).select("doc_id", "rep", "size").distinct(), "copies")
        self.signed = signed
        unique = _where_in(signed, self.copies.where("doc_id <> rep").select("doc_id"), "left_anti")
        self.pairs = materialize(self._exact(self._candidates(unique), texts), "pairs")

    def _candidates(self, unique: DataFrame) -> DataFrame:
        tau = budget(self.threshold)
        posted = unique.mapInArrow(_postings(tau), "key bigint, doc bigint, chain bigint")
        a = posted.select("key", F.col("doc").alias("a"), F.col("chain").alias("ca"))
        b = posted.select("key", F.col("doc").alias("b"), F.col("chain").alias("cb"))
        met = a.join(b, "key").where("a < b").where(_chain_within(F.col("ca"), F.col("cb"), tau)).select("a", "b").distinct()
        full = unique.select("doc_id", "n", *[f"g{i}" for i in range(_LONGS)]).dropDuplicates(["doc_id"])
        side = lambda p: full.select(F.col("doc_id").alias(p), F.col("n").alias(f"n{p}"), *[F.col(f"g{i}").alias(f"{p}{i}") for i in range(_LONGS)])
        both = met.join(side("a"), "a").join(side("b"), "b")
        distance = reduce(lambda x, y: x + y, [F.bit_count(_differing(F.col(f"a{i}"), F.col(f"b{i}"))) for i in range(_LONGS)])
        # sizes further apart than the threshold allows exclude the similarity outright
        near = (distance <= math.floor(tau)) & (F.least("na", "nb") >= F.greatest("na", "nb") * self.threshold)
        return both.where(near).select("a", "b")

    def _exact(self, candidates: DataFrame, texts: DataFrame) -> DataFrame:
        candidates = materialize(candidates, "candidates")
        involved = candidates.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        wanted = _where_in(texts, involved, "left_semi")
        ta = wanted.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
        tb = wanted.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
        rows = candidates.join(ta.hint("shuffle_hash"), "a").join(tb.hint("shuffle_hash"), "b")
        return rows.mapInArrow(_verify(self.shingle, self.threshold), "a bigint, b bigint, similarity double").distinct()

    def document_pairs(self, expand_copies: int | None = EXPAND_COPIES) -> DataFrame:
        """(doc_id_a, doc_id_b): pairs of documents, copies included as the module text says."""
        most = F.lit(expand_copies if expand_copies is not None else 2**62)
        small = self.copies.where(F.col("size") <= most)
        member = lambda c: small.select(F.col("rep").alias(c), F.col("doc_id").alias(f"m{c}"))
        spread = self.pairs.join(member("a"), "a", "left").join(member("b"), "b", "left").select(F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y"))
        inside = small.select("rep", F.col("doc_id").alias("x")).join(small.select("rep", F.col("doc_id").alias("y")), "rep").where("x < y").select("x", "y")
        star = self.copies.where((F.col("size") > most) & (F.col("doc_id") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("doc_id").alias("y"))
        return spread.unionByName(inside).unionByName(star).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))

    def membership(self) -> DataFrame:
        """(doc_id, class_id, n_copies, n_links): one row per document, links counted between different texts."""
        ends = self.pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
        rows = self.signed.select("doc_id").distinct().join(self.copies, "doc_id", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("size", F.lit(1)).alias("n_copies"))
        return rows.join(ends.withColumnRenamed("rep", "class_id"), "class_id", "left").select("doc_id", "class_id", F.col("n_copies").cast("bigint").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
