"""Evaluation texts leaking into training text, by latent semantic retrieval.

1. One pass over the corpus sketches the range of the passage-by-term matrix: every task sums, for
   its passages P (blocks of ``BLOCK`` words), P^T (P W) for a random W, and the passage
   frequency of every hashed term. The partial sums are added in a tree of groups of at most ``FAN_IN``, per slice of
   terms. From the sketch, scaled by the inverse passage frequency, come the singular vectors and values of the TF-IDF
   matrix (randomised SVD by the Nystrom form of P^T P); those under ``LEAST_SINGULAR`` of the largest are cut off.
2. The items' passages get the same SVD, for a benchmark may hold words that the corpus sketch does not reach. Both sets of
   singular vectors are the latent basis. Its size depends on the parameters only.
3. A second pass projects windows of two neighbouring blocks of every document and looks up the items' windows in an index
   of about ``CELL`` windows a cell: it is compared with the windows of its ``PROBES`` nearest cells, with all of them in a
   small benchmark. Documents x items over ``COSINE`` are candidates. The corpus is read once for ``ITEM_BLOCK`` items.
4. Each candidate is checked on the words themselves: the share of the item's distinct word runs
   that the document contains, the longest common subsequence of words around the best window,
   and whether the item's answer stands in the document.

The benchmark is a stated query set; no document text is shuffled.

Defined results: null, empty and short documents give no row; an item of fewer than ``RUN`` words
has no run and is never found verbatim; repeated item ids count as one item (smallest text);
repeated documents give repeated candidates, which ``dropDuplicates`` on (doc_id, item_id) reduces;
an empty corpus or benchmark gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.neighbours import kmeans
from quillgraph.llm.words import Hasher, runs, words

BLOCK = 12
TERMS = 8_192
CORPUS_RANK = 32
ITEM_RANK = 64
COSINE = 0.55
RUN = 4
SHARE = 0.35
#: A paraphrase needs this cosine, this share of the item's words in common order, and the answer if there is one.
PARAPHRASE_COSINE = 0.8
PARAPHRASE_LCS = 0.6
#: Item windows of a cell of their index, and cells a document's window is compared with.
CELL = 64
PROBES = 16
#: Singular values under this share of the largest are cut off.
LEAST_SINGULAR = 1e-4
#: Items held by every task at once; a larger benchmark is searched in several scans.
ITEM_BLOCK = 50_000
#: Partial sketches that one task adds up.
FAN_IN = 64
SLICE = 512
SEED = 5

FOUND = "doc_id bigint, item_id bigint, containment double, cosine double, lcs double, answer boolean"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("containment", pa.float64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.bool_())])


def _blocks(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat word ids, start of each block, owner of each block, position of each block in its owner."""
    starts, owner, place = [], [], []
    at = 0
    for d, w in enumerate(docs):
        n = -(-len(w) // BLOCK)
        starts.append(at + BLOCK * np.arange(n))
        owner.append(np.full(n, d))
        place.append(np.arange(n))
        at += len(w)
    flat = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
    if not len(flat):
        z = np.zeros(0, np.int64)
        return flat, z, z, z
    return flat, np.concatenate(starts), np.concatenate(owner), np.concatenate(place)


def _terms(flat: np.ndarray) -> np.ndarray:
    return (flat % np.uint64(TERMS)).astype(np.int64)


def _random(rank: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((TERMS, rank)).astype(np.float32)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of P^T (P W), with the passage frequency as last column, one row a slice of terms."""
    hasher, w = Hasher(), _random(CORPUS_RANK)
    total = np.zeros((TERMS, CORPUS_RANK + 1), np.float64)
    passages = 0
    for batch in batches:
        flat, starts, _, _ = _blocks([hasher.ids(t) for t in batch.column("text").to_pylist()])
        if not len(flat):
            continue
        f = _terms(flat)
        passages += len(starts)
        ends = np.append(starts[1:], len(f))
        for a in range(0, len(starts), 20_000):
            lo, hi = starts[a], ends[min(a + 20_000, len(starts)) - 1]
            part = f[lo:hi]
            projected = np.add.reduceat(w[part], starts[a : a + 20_000] - lo, axis=0)
            block = np.repeat(np.arange(len(projected)), ends[a : a + 20_000] - starts[a : a + 20_000])
            order = np.argsort(part, kind="stable")
            sorted_f, sorted_b = part[order], block[order]
            first = np.flatnonzero(np.append(True, np.diff(sorted_f) != 0))
            total[sorted_f[first], :CORPUS_RANK] += np.add.reduceat(projected[sorted_b], first, axis=0)
            fresh = np.append(True, (np.diff(sorted_f) != 0) | (np.diff(sorted_b) != 0))
            total[:, CORPUS_RANK] += np.bincount(sorted_f[fresh], minlength=TERMS)
    if passages:
        yield pa.RecordBatch.from_pydict(
            {
                "slice": pa.array(range(TERMS // SLICE), pa.int32()),
                "part": pa.array([total[i : i + SLICE].astype(np.float32).tobytes() for i in range(0, TERMS, SLICE)], pa.binary()),
                "passages": pa.array([passages] * (TERMS // SLICE), pa.int64()),
            }
        )


def _add_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(pdf["part"].iloc[0]) // 4, np.float64)
    for p in pdf["part"]:
        total += np.frombuffer(p, np.float32)
    return pd.DataFrame({"slice": pdf["slice"].iloc[:1].to_numpy(), "part": [total.astype(np.float32).tobytes()], "passages": [int(pdf["passages"].sum())], "task": pdf["task"].iloc[:1].to_numpy()})


def singular_vectors(products: np.ndarray, start: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and values of P S from products = P^T P W, start = W and the diagonal S.

    The Nystrom form of the randomised SVD: with Y = S P^T P W and the core C = W^T P^T P W, the factor B = Y C^(-1/2) has
    B B^T close to S P^T P S, so the left singular vectors of B are the right ones of P S and its singular values are theirs.
    """
    y = products.astype(np.float64)
    core = start.T.astype(np.float64) @ y
    lam, v = np.linalg.eigh((core + core.T) / 2)
    keep = lam > 1e-10 * max(float(lam.max(initial=0.0)), 1e-30)
    if not keep.any():
        return np.zeros((len(scale), 0)), np.zeros(0)
    u, s, _ = np.linalg.svd(scale[:, None] * (y @ (v[:, keep] / np.sqrt(lam[keep]))), full_matrices=False)
    kept = s > LEAST_SINGULAR * max(float(s.max(initial=0.0)), 1e-30)
    return u[:, kept], s[kept]


class Latent:
    """The basis for one block of items, and the items' windows in it."""

    def __init__(self, items: pd.DataFrame, corpus: tuple[np.ndarray, np.ndarray, int]):
        sketch, frequency, passages = corpus
        hasher = Hasher()
        texts = items["text"].tolist()
        ids = [hasher.ids(t) for t in texts]
        self.item_id = items["item_id"].to_numpy(np.int64)
        self.grams = [np.unique(runs(i, RUN)) for i in ids]
        self.ids = ids
        self.answer = [tuple(hasher[w] for w in words(a)) for a in map(answer_of, texts)]
        flat, starts, owner, place = _blocks(ids)
        f = _terms(flat)
        idf = np.log((passages + 1) / (frequency + 1)).astype(np.float32) + 1e-3
        vectors, self.singular = singular_vectors(sketch, _random(CORPUS_RANK), idf)
        start = np.random.default_rng(SEED + 1).standard_normal((TERMS, ITEM_RANK)).astype(np.float32)
        products = np.zeros((TERMS, ITEM_RANK), np.float64)
        if len(f):
            block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(f))))
            np.add.at(products, f, np.add.reduceat(start[f], starts, axis=0)[block])
        own, _ = singular_vectors(products, start, idf)
        basis, _ = np.linalg.qr(np.concatenate([vectors, own], axis=1)) if len(self.singular) or own.shape[1] else (np.zeros((TERMS, 1)), None)
        self.embed = (idf[:, None] * basis).astype(np.float32)
        self.windows, self.window_item, _ = self.project(f, starts, owner, place)
        self._index()

    def _index(self) -> None:
        """Item windows ordered by the cell of their nearest centroid."""
        cells = max(1, len(self.windows) // CELL)
        if cells <= PROBES:
            self.centres, self.bounds = None, np.array([0, len(self.windows)])
            return
        self.centres = kmeans(self.windows, cells, 6, np.random.default_rng(SEED), spherical=True)
        near = np.argmax(self.windows @ self.centres.T, axis=1)
        order = np.argsort(near, kind="stable")
        self.windows, self.window_item = np.ascontiguousarray(self.windows[order]), self.window_item[order]
        self.bounds = np.searchsorted(near[order], np.arange(cells + 1))

    def near(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item window, cosine) over COSINE for some windows of documents."""
        if self.centres is None:
            sims = (w @ self.windows.T).ravel()
            hit = np.flatnonzero(sims > COSINE)
            return hit // max(1, len(self.windows)), hit % max(1, len(self.windows)), sims[hit]
        to = w @ self.centres.T
        cells = np.argpartition(-to, PROBES - 1, axis=1)[:, :PROBES]
        flat = cells.ravel()
        order = np.argsort(flat, kind="stable")
        edge = np.searchsorted(flat[order], np.arange(len(self.centres) + 1))
        out = []
        for c in np.unique(flat):
            rows = order[edge[c] : edge[c + 1]] // PROBES
            a, z = self.bounds[c], self.bounds[c + 1]
            sims = w[rows] @ self.windows[a:z].T
            r, i = np.nonzero(sims > COSINE)
            out.append((rows[r], i + a, sims[r, i]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def project(self, f: np.ndarray, starts: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of windows of two neighbouring blocks, their owners and first blocks."""
        if not len(f):
            return np.zeros((0, self.embed.shape[1]), np.float32), owner, place
        sums = np.empty((len(starts), self.embed.shape[1]), np.float32)
        ends = np.append(starts[1:], len(f))
        for a in range(0, len(starts), 2_000):
            z = min(a + 2_000, len(starts))
            sums[a:z] = np.add.reduceat(self.embed[f[starts[a] : ends[z - 1]]], starts[a:z] - starts[a], axis=0)
        joins = np.append(owner[1:] == owner[:-1], False)
        sums[:-1][joins[:-1]] += sums[1:][joins[:-1]]
        keep = joins | (place == 0)
        w = sums[keep]
        w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)
        return w, owner[keep], place[keep]


_ANSWER = re.compile(r"\banswer\s*[:：]\s*(.+?)(?:[.!?](?:\s|$)|\n|$)", re.IGNORECASE)


def answer_of(text: str | None) -> str | None:
    """The answer a question-answer item spells after ``Answer:``, if it does."""
    m = _ANSWER.search(text or "")
    return m.group(1) if m else None


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & at.get(x, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _contains(ids: np.ndarray, phrase: tuple[int, ...]) -> bool:
    if not phrase or len(ids) < len(phrase):
        return False
    hit = ids[: len(ids) - len(phrase) + 1] == np.uint64(phrase[0])
    for i in range(1, len(phrase)):
        hit &= ids[i : len(ids) - len(phrase) + 1 + i] == np.uint64(phrase[i])
    return bool(hit.any())


def _search(latent: Latent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        n_items = len(latent.item_id)
        for batch in batches:
            doc_id = batch.column("doc_id").to_pylist()
            docs = [hasher.ids(t) for t in batch.column("text").to_pylist()]
            flat, starts, owner, place = _blocks(docs)
            if not len(flat) or not len(latent.windows):
                continue
            w, owner, place = latent.project(_terms(flat), starts, owner, place)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a in range(0, len(w), 4_000):
                r, i, c = latent.near(w[a : a + 4_000])
                found.append((r + a, i, c))
            row, col, sim = (np.concatenate(x) for x in zip(*found))
            if not len(row):
                continue
            pair = owner[row].astype(np.int64) * n_items + latent.window_item[col]
            order = np.lexsort((-sim, pair))
            first = np.append(True, np.diff(pair[order]) != 0)
            best = order[first]
            yield _checked(latent, doc_id, docs, owner[row[best]], latent.window_item[col[best]], place[row[best]], sim[best])

    return run


def _checked(latent: Latent, doc_id: list, docs: list[np.ndarray], of: np.ndarray, item: np.ndarray, place: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    out: list[tuple] = []
    grams: np.ndarray | None = None
    last = -1
    for d, i, p, s in zip(of.tolist(), item.tolist(), place.tolist(), sim.tolist()):
        if d != last:  # pairs come ordered by document
            grams, last = np.unique(runs(docs[d], RUN)), d
        mine = latent.grams[i]
        share = 0.0
        if len(mine) and len(grams):
            where = np.minimum(np.searchsorted(grams, mine), len(grams) - 1)
            share = float((grams[where] == mine).mean())
        near = share >= SHARE or s >= PARAPHRASE_COSINE
        lcs = answer = None
        if near and doc_id[d] is not None:
            length = len(latent.ids[i])
            around = docs[d][max(0, p * BLOCK - length) : (p + 2) * BLOCK + length]
            lcs = lcs_length(latent.ids[i].tolist(), around.tolist()) / max(1, length)
            answer = _contains(docs[d], latent.answer[i]) if latent.answer[i] else None
            out.append((doc_id[d], int(latent.item_id[i]), share, s, lcs, answer))
    columns = list(zip(*out)) or [[]] * len(_FOUND_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND_ARROW)], schema=_FOUND_ARROW)


def corpus_sketch(documents: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Sketch, passage frequencies and number of passages over all documents."""
    texts = documents.where("text is not null").select("text")
    schema = "slice int, part binary, passages bigint"
    parts = texts.mapInArrow(_sketch_batches, schema).withColumn("task", F.spark_partition_id())
    tasks = texts.rdd.getNumPartitions()
    while True:  # a tree: no task adds more than FAN_IN parts
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("task", (F.col("task") / FAN_IN).cast("int")).groupBy("slice", "task").applyInPandas(_add_parts, f"{schema}, task int")
        if tasks <= 1:
            break
    rows = parts.toPandas().sort_values("slice")
    if rows.empty:
        return np.zeros((TERMS, CORPUS_RANK), np.float32), np.zeros(TERMS), 0
    total = np.concatenate([np.frombuffer(p, np.float32).reshape(-1, CORPUS_RANK + 1) for p in rows["part"]])
    return total[:, :CORPUS_RANK].astype(np.float32), total[:, CORPUS_RANK], int(rows["passages"].iloc[0])


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, containment, cosine, lcs, answer) of documents that hold an item or come near to one."""
    spark = documents.sparkSession
    items = benchmark.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    corpus = corpus_sketch(documents)
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    texts = documents.where("text is not null and doc_id is not null").select("doc_id", "text")
    out = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").toPandas()
        if block.empty:
            continue
        found = texts.mapInArrow(_search(Latent(block, corpus)), FOUND)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], FOUND) if out is None else out.dropDuplicates(["doc_id", "item_id"])


def verdicts(leaks: DataFrame) -> DataFrame:
    """Leaks with their kind: whole (every run), part (at least SHARE of them) or paraphrase."""
    paraphrase = (F.col("cosine") >= PARAPHRASE_COSINE) & (F.col("lcs") >= PARAPHRASE_LCS) & F.coalesce("answer", F.lit(True))
    kind = F.when(F.col("containment") >= 1, "whole").when(F.col("containment") >= SHARE, "part").when(paraphrase, "paraphrase")
    return leaks.withColumn("kind", kind).where("kind is not null")
