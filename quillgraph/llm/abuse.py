"""Scoring texts for abusive, hateful or sexual language with a factorization machine.

Text is first brought back to plain spelling: entities, invisible characters, look-alike letters,
digits and signs used as letters, and letters set apart by blanks or hyphens. Its words, word pairs
and letter-order-free word keys are hashed terms. A factorization machine scores windows of
neighbouring words: linear weights plus the interaction of every two terms in the window, so
that an insult weighs more beside an address or a group name than in a kennel report. A document
scores as its worst window. What is abusive is learned from the marks alone; there is no word list.

Marks are given to whole documents, so training is by multiple instances: a marked document
teaches by its currently worst windows, an unmarked one by those most like abuse. Some marks
are wrong: two halves of the marked documents judge each other first, and each mark counts in the final
fit by how well the other half's machine agrees with it. The same held-out scores set the
threshold: the middle of the gap that separates the marks best (largest F1). A score is the logistic of the
distance to it, so 0.5 is the threshold at every size.

The machine is fitted on at most ``LABEL_ROWS`` marked documents and ``LABEL_CHARS`` characters
(hash-chosen if there are more), in executor tasks; every document is scored over its whole text.

Defined results: null, empty and wordless texts score 0; documents marked both ways count by the
majority, ties as not abusive; without any mark of one kind every score is 0; a null source is reported as null;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import broadcast_if_small, materialize

#: Bounds of the marked sample the machine is fitted on.
LABEL_ROWS = 20_000
LABEL_CHARS = 64 << 20
TERMS = 1 << 17
RANK = 8
#: Words of a block; a window is two neighbouring blocks.
BLOCK = 6
#: Value of a term in a window, so that a full window has length one.
VALUE = (6 * BLOCK) ** -0.5
ROUNDS = 3
EPOCHS = 4
#: Marked documents a term must stand in to be learned.
MIN_DOCUMENTS = 3
#: Log-odds by which the other half must contradict a mark before it counts half.
DOUBT = 1.0
THRESHOLD = 0.5
SEED = 7

#: Letters of other scripts that look like Latin ones (fixed values).
_LOOKS = dict(zip("авеёзкмнорсстухіјѕԁһӏԛԝ", "abee3kmhopcctyxijsdhlqw")) | dict(zip("αβεηικνορτυχω", "abenikvoptuxw"))
_LOOKS |= {"ѵ": "v", "ү": "y", "ց": "g", "օ": "o", "ո": "n", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "@": "a", "$": "s", "€": "e", "’": "'"}
_LOOK = re.compile("[" + "".join(map(re.escape, _LOOKS)) + "]")
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u206a-\u206f\ufe00-\ufe0f\ufeff]")
_DIGITS = str.maketrans("013457", "oieast")
_APART = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*·][^\W_]){2,}(?![^\W_])")
_SIGN_INSIDE = re.compile(r"(?<=[^\W\d_])[!|](?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_HAS_DIGIT = re.compile(r"\d")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """Lower-case text with disguised letters brought back."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    text = _LOOK.sub(lambda m: _LOOKS[m.group()], text.lower())
    if "!" in text or "|" in text:
        text = _SIGN_INSIDE.sub("i", text)
    return _APART.sub(lambda m: re.sub(r"[ .\-_*·]", "", m.group()), text)


def _keys(word: str) -> tuple[int, int]:
    """Hashes of a word as it stands and of its letters without their order or repetition."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    if word.isdigit():
        word = "0"
    elif _HAS_DIGIT.search(word):
        word = word.translate(_DIGITS)
    key = xxhash.xxh64_intdigest(word)
    return key, xxhash.xxh64_intdigest("~" + word[0] + "".join(sorted(set(word[1:])))) if len(word) > 3 else key


class Terms(dict):
    """Numbers of words with their hashed keys, cached per task."""

    LIMIT = 2_000_000

    def __init__(self) -> None:
        super().__init__()
        self._fresh: list[tuple[int, int]] = []
        self._held = np.zeros((0, 2), np.uint64)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self._held) + len(self._fresh)
        self._fresh.append(_keys(word))
        return n

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """Hashed terms (words, 3) of each text: word, pair with the next word, letter bag."""
        if len(self) > self.LIMIT:
            self.clear()
            self.__init__()
        out = []
        numbers = [np.array([self[w] for w in _WORD.findall(plain(t))] if t else [], np.int64) for t in texts]
        if self._fresh:
            self._held = np.concatenate([self._held, np.array(self._fresh, np.uint64)])
            self._fresh = []
        for n in numbers:
            pairs = self._held[n]
            word = pairs[:, 0]
            after = np.append(word[1:], np.uint64(0))[: len(word)]
            both = (word * _MIX) ^ (after + (word >> np.uint64(31)))
            both *= _MIX
            both ^= both >> np.uint64(32)
            out.append((np.stack([word, both, pairs[:, 1]], axis=1) % np.uint64(TERMS)).astype(np.int32))
        return out


def windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat terms, start of each block, owner of each block, whether it has a next block."""
    starts, owner = [], []
    at = 0
    for d, t in enumerate(docs):
        n = -(-len(t) // BLOCK)
        starts.append(at + BLOCK * np.arange(n))
        owner.append(np.full(n, d))
        at += len(t)
    flat = np.concatenate(docs) if docs else np.zeros((0, 3), np.int32)
    starts, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, owner))
    return flat, starts.astype(np.int64), owner.astype(np.int64), np.append(owner[1:] == owner[:-1], False) if len(owner) else np.zeros(0, bool)


class Machine:
    """Linear weights and factors of hashed terms; log-odds are counted from ``cut``."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.bias = self.cut = 0.0
        self.w = np.zeros(TERMS, np.float32)
        self.v = (0.1 * rng.standard_normal((TERMS, RANK))).astype(np.float32)
        self._gw = np.full(TERMS, 1e-2, np.float32)
        self._gv = np.full((TERMS, RANK), 1e-2, np.float32)
        self._gb = 1e-2

    def forget(self, terms: np.ndarray) -> None:
        self.w[terms] = 0
        self.v[terms] = 0

    def table(self) -> np.ndarray:
        """Per term: weight, factors, squared factors summed, each times the value of a term."""
        return np.concatenate([VALUE * self.w[:, None], VALUE * self.v, VALUE * VALUE * (self.v * self.v).sum(axis=1, keepdims=True)], axis=1)

    def score_sums(self, s: np.ndarray) -> np.ndarray:
        inner = s[:, 1 : 1 + RANK]
        return self.bias - self.cut + s[:, 0] + 0.5 * ((inner * inner).sum(axis=1) - s[:, 1 + RANK])

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, rng: np.random.Generator, rate: float = 0.3, decay: float = 1e-4) -> None:
        """Logistic loss by AdaGrad; ``x`` holds term rows padded with -1."""
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), 256):
                rows = order[a : a + 256]
                ids = x[rows]
                there = ids >= 0
                safe = np.where(there, ids, 0)
                v = self.v[safe] * there[:, :, None] * np.float32(VALUE)
                total = v.sum(axis=1)
                z = self.bias + VALUE * (self.w[safe] * there).sum(axis=1) + 0.5 * ((total * total).sum(axis=1) - (v * v).sum(axis=(1, 2)))
                g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows]).astype(np.float32)
                used, back = np.unique(ids[there], return_inverse=True)
                by = np.argsort(back, kind="stable")
                first = np.searchsorted(back[by], np.arange(len(used)))
                gv = (np.float32(VALUE) * g[:, None, None] * (total[:, None, :] - v))[there][by]
                gw = np.float32(VALUE) * np.broadcast_to(g[:, None], ids.shape)[there][by]
                dw = np.add.reduceat(gw, first) + decay * self.w[used]
                dv = np.add.reduceat(gv, first, axis=0) + decay * self.v[used]
                self._gw[used] += dw * dw
                self._gv[used] += dv * dv
                self.w[used] -= rate * dw / np.sqrt(self._gw[used])
                self.v[used] -= 0.5 * rate * dv / np.sqrt(self._gv[used])
                gb = float(g.sum())
                self._gb += gb * gb
                self.bias -= rate * gb / np.sqrt(self._gb)


def _window_sums(table: np.ndarray, flat: np.ndarray, starts: np.ndarray, joins: np.ndarray) -> np.ndarray:
    sums = np.empty((len(starts), table.shape[1]), np.float32)
    ends = np.append(starts[1:], len(flat))
    for a in range(0, len(starts), 10_000):
        z = min(a + 10_000, len(starts))
        part = flat[starts[a] : ends[z - 1]]
        each = table[part[:, 0]]
        each += table[part[:, 1]]
        each += table[part[:, 2]]
        sums[a:z] = np.add.reduceat(each, starts[a:z] - starts[a], axis=0)
    sums[:-1][joins[:-1]] += sums[1:][joins[:-1]]
    return sums


def _tails(owner: np.ndarray, joins: np.ndarray) -> np.ndarray:
    """Last blocks that the window before them already holds."""
    return ~joins & np.append(False, owner[1:] == owner[:-1])


class Marked:
    """Marked documents as windows, with what training needs to know of each window."""

    def __init__(self, docs: list[np.ndarray], marks: np.ndarray):
        self.flat, self.starts, self.owner, self.joins = windows(docs)
        ends = np.append(self.starts[1:], len(self.flat))
        self.until = np.where(self.joins, np.append(ends[1:], len(self.flat)), ends)
        self.first = np.searchsorted(self.owner, np.arange(len(docs)))
        self.blocks = np.diff(np.append(self.first, len(self.owner)))
        self.tails = _tails(self.owner, self.joins)
        self.positive = np.asarray(marks) == 1
        self.docs = docs

    def score(self, machine: Machine) -> np.ndarray:
        return np.where(self.tails, -np.inf, machine.score_sums(_window_sums(machine.table(), self.flat, self.starts, self.joins)))

    def worst(self, machine: Machine) -> np.ndarray:
        return np.maximum.reduceat(self.score(machine), self.first)

    def fit(self, trust: np.ndarray) -> Machine | None:
        """A machine fitted on the documents of positive trust, or None if a kind of mark is missing there."""
        positive, owner, use = self.positive, self.owner, trust > 0
        if not (positive & use).any() or not (~positive & use).any():
            return None
        rng = np.random.default_rng(SEED)
        # start: log-odds of each term over documents
        counts = np.zeros((2, TERMS))
        seen = np.zeros(TERMS)
        for d in np.flatnonzero(use):
            there = np.unique(self.docs[d])
            counts[int(positive[d]), there] += trust[d]
            seen[there] += 1
        of = trust @ positive, trust @ ~positive
        odds = np.log((counts[1] + 0.1) / (of[0] + 0.2)) - np.log((counts[0] + 0.1) / (of[1] + 0.2))
        rare = seen < MIN_DOCUMENTS
        odds[rare] = 0
        start = np.zeros((TERMS, 2 + RANK), np.float32)
        start[:, 0] = np.clip(odds, -1, 4)
        score = np.where(self.tails, -np.inf, _window_sums(start, self.flat, self.starts, self.joins)[:, 0])
        machine = Machine()
        for round_ in range(ROUNDS):
            order = np.lexsort((-score, owner))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - self.first[owner[order]]
            mine = positive[owner] & ((rank < 1) | (score > 0) & (round_ > 0))
            others = ~positive[owner] & ((rank < 2) | (rng.random(len(owner)) < 2 / self.blocks[owner]))
            chosen = np.flatnonzero((mine | others) & ~self.tails & use[owner])
            y = positive[owner[chosen]].astype(np.float32)
            x = np.full((len(chosen), 2 * BLOCK, 3), -1, np.int32)
            for j, c in enumerate(chosen):
                part = self.flat[self.starts[c] : self.until[c]]
                x[j, : len(part)] = np.where(rare[part], -1, part)
            balance = min(20.0, max(1.0, (len(y) - y.sum()) / max(1.0, y.sum()) / 2))
            weight = np.where(y == 1, balance, 1.0) * trust[owner[chosen]]
            machine = Machine()
            machine.fit(x.reshape(len(chosen), -1), y, weight.astype(np.float32), EPOCHS, rng)
            machine.forget(np.flatnonzero(rare))
            score = self.score(machine)
        return machine


def best_cut(scores: np.ndarray, positive: np.ndarray) -> float:
    """The middle of the gap between held-out scores at which F1 is largest; ties go to the widest gap."""
    order = np.argsort(-scores, kind="stable")
    s, p = scores[order], positive[order]
    hits = np.cumsum(p)
    f1 = np.round(2 * hits / (np.arange(1, len(s) + 1) + p.sum()), 6)
    gap = s - np.append(s[1:], s[-1] - 1)
    f1[gap <= 0] = -1
    best = np.flatnonzero(f1 == f1.max())
    i = best[np.argmax(gap[best])]
    return float(s[i] - min(gap[i], 4.0) / 2)


def halves(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).permutation(n) % 2


def prepared(texts: list[str | None], marks: np.ndarray) -> Marked | None:
    """Marked documents with words, or None if they hold one kind of mark only."""
    docs = Terms().of(texts)
    keep = [i for i, d in enumerate(docs) if len(d)]
    docs, marks = [docs[i] for i in keep], np.asarray(marks)[keep]
    if not len(docs) or marks.min() == marks.max():
        return None
    return Marked(docs, marks)


def judged(data: Marked, half: int) -> np.ndarray:
    """Log-odds of every document by a machine fitted on one half; NaN in that half."""
    inside = halves(len(data.docs)) == half
    machine = data.fit(inside.astype(np.float64))
    if machine is None:
        return np.full(len(data.docs), np.nan)
    return np.where(inside, np.nan, data.worst(machine))


def final(data: Marked, held_out: np.ndarray) -> Machine | None:
    """The machine fitted on all marks, each weighted by the trust of the other half, with its threshold."""
    known = ~np.isnan(held_out)
    z = np.where(known, held_out, 0.0)
    agrees = np.where(data.positive, z, -z)
    trust = np.where(known, 1 / (1 + np.exp(-np.clip(agrees + DOUBT, -30, 30))), 0.5)
    machine = data.fit(trust)
    if machine is not None and data.positive[known].any():
        machine.cut = best_cut(z[known], data.positive[known])
    return machine


def train(texts: list[str | None], marks: np.ndarray) -> Machine | None:
    """A machine fitted on marked documents, or None if a kind of mark is missing."""
    data = prepared(texts, marks)
    if data is None:
        return None
    a, b = judged(data, 0), judged(data, 1)
    return final(data, np.where(np.isnan(a), b, a))


def _judge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Held-out log-odds of the documents outside one half."""
    pdf = pdf.sort_values("doc_id", kind="stable")
    data = prepared(pdf["text"].tolist(), pdf["mark"].to_numpy())
    if data is None:
        return pd.DataFrame({"doc_id": pd.Series([], dtype="int64"), "held_out": pd.Series([], dtype="float64")})
    z = judged(data, int(pdf["half"].iloc[0]))
    worded = pdf["doc_id"].to_numpy()[[bool(_WORD.search(plain(t))) if t else False for t in pdf["text"]]]
    return pd.DataFrame({"doc_id": worded, "held_out": z})[~np.isnan(z)]


def _final(pdf: pd.DataFrame) -> pd.DataFrame:
    """The final machine as one row."""
    pdf = pdf.sort_values("doc_id", kind="stable")
    data = prepared(pdf["text"].tolist(), pdf["mark"].to_numpy())
    machine = None
    if data is not None:
        worded = [bool(_WORD.search(plain(t))) if t else False for t in pdf["text"]]
        machine = final(data, pdf["held_out"].to_numpy(np.float64)[worded])
    if machine is None:
        return pd.DataFrame({"bias": pd.Series([], dtype="float64"), "cut": pd.Series([], dtype="float64"), "weights": pd.Series([], dtype="object")})
    return pd.DataFrame({"bias": [machine.bias], "cut": [machine.cut], "weights": [np.concatenate([machine.w[:, None], machine.v], axis=1).astype(np.float32).tobytes()]})


def marked_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, mark) of the marked documents, at most LABEL_ROWS and LABEL_CHARS of them by the hash of their id."""
    order = F.xxhash64("doc_id")
    votes = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg((F.avg("toxic") > 0.5).cast("int").alias("mark"))
    chosen = votes.orderBy(order, "doc_id").limit(LABEL_ROWS)
    texts = documents.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    marked = materialize(texts.join(broadcast_if_small(chosen, LABEL_ROWS), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("mark").alias("mark")), "marked")
    room = marked.select("doc_id", F.sum(F.length("text")).over(Window.orderBy(order, "doc_id")).alias("_chars"))  # LABEL_ROWS rows at most
    return marked.join(F.broadcast(room.where(F.col("_chars") <= LABEL_CHARS).select("doc_id")), "doc_id", "left_semi")


def fitted(documents: DataFrame, labels: DataFrame) -> Machine | None:
    """The machine fitted in executor tasks, or None if a kind of mark is missing. Its size depends on TERMS and RANK only."""
    marked = marked_documents(documents, labels)
    twice = marked.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    held = twice.groupBy("half").applyInPandas(_judge, "doc_id bigint, held_out double")
    row = marked.join(held, "doc_id", "left").withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_final, "bias double, cut double, weights binary").collect()
    if not row:
        return None
    machine = Machine()
    weights = np.frombuffer(row[0]["weights"], np.float32).reshape(TERMS, 1 + RANK)
    machine.bias, machine.cut, machine.w, machine.v = row[0]["bias"], row[0]["cut"], weights[:, 0], weights[:, 1:]
    return machine


def _score(machine: Machine | None):
    table = None if machine is None else machine.table()
    offset = 0.0 if machine is None else machine.bias - machine.cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        judge = Machine.__new__(Machine)
        judge.bias, judge.cut = offset, 0.0
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if table is not None and batch.num_rows:
                flat, starts, owner, joins = windows(terms.of(batch.column("text").to_pylist()))
                if len(flat):
                    z = np.where(_tails(owner, joins), -np.inf, judge.score_sums(_window_sums(table, flat, starts, joins)))
                    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                    out[owner[first]] = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(z, first), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(out)], names=["doc_id", "source", "score"])

    return run


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score) of every document."""
    return documents.select("doc_id", "source", "text").mapInArrow(_score(fitted(documents, labels)), "doc_id bigint, source string, score double")


def source_rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, those at or over the threshold, and their rate."""
    return scored.groupBy("source").agg(
        F.count("*").alias("n_documents"),
        F.count_if(F.col("score") >= threshold).alias("n_flagged"),
        (F.count_if(F.col("score") >= threshold) / F.count("*")).alias("rate"),
    )
