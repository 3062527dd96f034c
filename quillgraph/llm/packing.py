"""Filling fixed-capacity containers with texts of varying length (vector best fit).

Lengths are tokens of a public byte-pair vocabulary. A text longer than its container is cut into
full pieces and a remainder; every other text stays whole. A container has three capacities:
tokens, number of documents and attention cost (sum of squared lengths, what attention inside documents costs).
Items come in decreasing length; each goes to the open container that can take it under every
constraint and whose residual vector, weighted by the scarcity of each dimension, is then the
shortest; if none can, a new container is opened.

The attention capacity keeps containers of equal tokens from differing much in computing time, for the dearest one
makes all others of a step wait: ``ATTENTION_SHARE`` of the square of the tokens. An item
that alone costs more (a full piece) opens a container whose attention capacity is its own cost and the same share
of the square of the room beside it.

Scale: texts are measured where they lie and only (doc_id, piece, length) moves on. The items of each
capacity are spread over shards of about ``SHARD_ITEMS`` by a hash of their id, so no key and no source makes a
large shard; a shard leaves at most about one poorly filled container.

Defined results: null and empty texts take no room and are in no container; a source without
usable ``pack_tokens`` has the default; repeated rows are packed once each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import ast
import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import broadcast_if_small, materialize

DEFAULT_TOKENS = 2048
MAX_DOCUMENTS = 64
#: Attention capacity as a share of the square of the token capacity.
ATTENTION_SHARE = 0.7
SHARD_ITEMS = 20_000
#: Folder of the public vocabulary files; never copied.
VOCABULARY_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

_encoders: dict[str, object] = {}


def split_pattern(directory: str) -> str:
    """The splitting pattern that the vocabulary folder states, read as data."""
    with open(f"{directory}/__init__.py") as source:
        tree = ast.parse(source.read())
    stated = {t.id: node.value for node in tree.body if isinstance(node, ast.Assign) for t in node.targets if isinstance(t, ast.Name)}
    return ast.literal_eval(stated["PATTERN"])


def encoder(directory: str = VOCABULARY_DIR, name: str = VOCABULARY):
    """The tiktoken encoder of a vocabulary file, loaded once per process."""
    path = f"{directory}/{name}"
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=split_pattern(directory), mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(texts: list[str | None], directory: str = VOCABULARY_DIR, name: str = VOCABULARY) -> list[int]:
    enc = encoder(directory, name)
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def _measure(directory: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = token_counts(batch.column("text").to_pylist(), directory, name)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("capacity"), pa.array(n, pa.int32())], names=["doc_id", "capacity", "n"])

    return run


def items(documents: DataFrame, config: DataFrame, directory: str = VOCABULARY_DIR, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece_no, n_tokens, capacity): whole texts, or the pieces of one that exceeds its container."""
    sized = config.where("source is not null").groupBy(F.col("source").alias("_source")).agg(F.min(F.when(F.col("pack_tokens") >= 1, F.col("pack_tokens"))).alias("_pack"))
    limited = (
        documents.where("text is not null and text <> ''")
        .select("doc_id", "text", F.col("source").alias("_source"))
        .join(broadcast_if_small(sized), "_source", "left")
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("_pack", F.lit(DEFAULT_TOKENS)).cast("int").alias("capacity"), "text")
    )
    counted = limited.mapInArrow(_measure(directory, name), "doc_id bigint, capacity int, n int").where("n > 0")
    pieces = counted.select("doc_id", "capacity", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / F.col("capacity")).cast("int"))).alias("piece_no"))
    return pieces.select("doc_id", "piece_no", F.least(F.col("capacity"), F.col("n") - F.col("piece_no") * F.col("capacity")).alias("n_tokens"), "capacity")


def best_fit(lengths: np.ndarray, capacity: int, max_documents: int = MAX_DOCUMENTS, attention: float = ATTENTION_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Container number and token offset of each item; no length exceeds ``capacity``."""
    n = len(lengths)
    lengths = lengths.astype(np.float64)
    cost = lengths * lengths
    cap = np.array([capacity, max_documents, attention * capacity * capacity], np.float64)
    demand = np.array([lengths.sum(), n, cost.sum()]) / cap
    weight = demand / max(demand.sum(), 1e-12)
    order = np.argsort(-lengths, kind="stable")
    smallest = float(lengths.min(initial=1.0))
    left = np.empty((1024, 3))
    number = np.empty(1024, np.int64)
    open_, made = 0, 0
    where, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in order:
        need = (lengths[i], 1.0, cost[i])
        r = left[:open_]
        fits = np.flatnonzero((r[:, 0] >= need[0]) & (r[:, 1] >= 1.0) & (r[:, 2] >= need[2]))
        if len(fits):
            after = (r[fits] - need) / cap
            b = int(fits[np.argmin((after * after) @ weight)])
        else:
            if open_ == len(left):
                left, number = np.concatenate([left, np.empty_like(left)]), np.concatenate([number, np.empty_like(number)])
            b = open_
            left[b], number[b] = cap, made
            left[b, 2] = max(cap[2], cost[i] + attention * (capacity - lengths[i]) ** 2)
            open_, made = open_ + 1, made + 1
        where[i], offset[i] = number[b], capacity - left[b, 0]
        left[b] -= need
        if left[b, 0] < smallest or left[b, 1] < 1.0:  # closed: the last open container takes its place
            open_ -= 1
            left[b], number[b] = left[open_], number[open_]
    return where, offset


PACKED = "doc_id bigint, piece_no int, n_tokens int, capacity int, container string, start int"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
    capacity, shard = int(pdf["capacity"].iloc[0]), int(pdf["shard"].iloc[0])
    where, offset = best_fit(pdf["n_tokens"].to_numpy(), capacity)
    out = pdf[["doc_id", "piece_no", "n_tokens", "capacity"]].copy()
    out["container"] = [f"{capacity}-{shard}-{w}" for w in where]
    out["start"] = offset
    return out


def pack(documents: DataFrame, config: DataFrame, directory: str = VOCABULARY_DIR, name: str = VOCABULARY) -> DataFrame:
    """Every item with its container and the token at which it starts there."""
    measured = materialize(items(documents, config, directory, name), "items")
    shards = measured.groupBy("capacity").agg(F.ceil(F.count("*") / SHARD_ITEMS).alias("_shards"))
    spread = measured.join(broadcast_if_small(shards), "capacity").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("_shards"))).drop("_shards")
    return spread.groupBy("capacity", "shard").applyInPandas(_pack, PACKED)


def fill(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, items, the share of room that is used, and the highest attention cost as a share of the squared capacity."""
    tokens = F.col("n_tokens").cast("bigint")
    one = packed.groupBy("capacity", "container").agg(F.sum(tokens).alias("used"), F.sum(tokens * tokens).alias("cost"), F.count("*").alias("n"))
    return one.groupBy("capacity").agg(
        F.count("*").alias("n_containers"),
        F.sum("n").alias("n_items"),
        (F.sum("used") / (F.count("*") * F.col("capacity"))).alias("fill"),
        (F.avg("cost") / (F.first("capacity").cast("double") * F.first("capacity"))).alias("mean_attention"),
    )


def broken_containers(packed: DataFrame) -> DataFrame:
    """(container, fault): containers that exceed a capacity, overlap or repeat a piece; empty if the packing is right."""
    tokens = F.col("n_tokens").cast("bigint")
    one = packed.groupBy("container", "capacity").agg(
        F.sum(tokens).alias("used"), F.sum(tokens * tokens).alias("cost"), F.max(tokens).alias("longest"), F.count("*").alias("n"), F.max(F.col("start") + F.col("n_tokens")).alias("until"), F.countDistinct("start").alias("starts")
    )
    room = F.col("capacity").cast("double")
    most = F.greatest(ATTENTION_SHARE * room * room, F.col("longest") * F.col("longest") + ATTENTION_SHARE * (room - F.col("longest")) * (room - F.col("longest")))
    fault = (
        F.when(F.col("used") > F.col("capacity"), "tokens")
        .when(F.col("n") > MAX_DOCUMENTS, "documents")
        .when(F.col("cost") > most + 0.5, "attention")
        .when((F.col("until") != F.col("used")) | (F.col("starts") != F.col("n")), "places")
    )
    return one.select("container", fault.alias("fault")).where("fault is not null")
