"""Model-backed steps as batch plug-ins with deterministic offline stand-ins, and their caches.

A plug-in is a function from a list of inputs to a list of outputs. It runs in ``mapInPandas`` over the
rows that the cache does not hold (an anti-join on a hash of the request), so a rerun pays only for
what is new.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Reader = Callable[[Sequence[tuple[str, str]]], Sequence[str]]
Extractor = Callable[[Sequence[str]], Sequence[str]]


def hashed_embedder(dim: int = 64) -> Embedder:
    """Offline embedder: hashed character trigrams, unit length."""

    def run(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            s = f"  {t.lower()} "
            for i in range(len(s) - 2):
                h = int.from_bytes(hashlib.blake2b(s[i : i + 3].encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            out.append((v / max(float(np.linalg.norm(v)), 1e-12)).tolist())
        return out

    return run


def embed_texts(texts: DataFrame, embedder: Embedder, cache: DataFrame | None = None) -> DataFrame:
    """(text, v) for distinct texts; with ``cache`` (text, v) only texts it lacks are embedded."""
    wanted = texts.select("text").where("text is not null").distinct()
    missing = wanted.join(cache.select("text"), "text", "left_anti") if cache is not None else wanted

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"text": pdf["text"], "v": [list(map(float, v)) for v in embedder(pdf["text"].tolist())]})

    fresh = missing.mapInPandas(run, "text string, v array<float>")
    return fresh if cache is None else fresh.unionByName(wanted.join(cache.select("text", "v"), "text"))


def request_key(model: str, *columns: str):
    """Cache key of a request: the model and the content, nothing of how it is run."""
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), *columns), {"ignoreNullFields": "false"}), 256)


def call_cached(requests: DataFrame, model: str, call: Callable[[Sequence[str]], Sequence[str]], cache: DataFrame | None = None) -> DataFrame:
    """(key, prompt, response, hit): responses from the cache (key, response), or from the model; empty ones are null."""
    keyed = requests.select("prompt").distinct().withColumn("key", request_key(model, "prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "prompt": pdf["prompt"], "response": [r or None for r in call(pdf["prompt"].tolist())], "hit": False})

    schema = "key string, prompt string, response string, hit boolean"
    if cache is None:
        return keyed.mapInPandas(run, schema)
    known = cache.where("response is not null").select("key", "response").dropDuplicates(["key"])
    fresh = keyed.join(known.select("key"), "key", "left_anti").select("key", "prompt").mapInPandas(run, schema)
    return fresh.unionByName(keyed.join(known, "key").select("key", "prompt", "response", F.lit(True).alias("hit")))


FACT_JSON = "array<struct<text:string, relation:string, mentions:array<struct<name:string, type:string>>>>"
#: Mention types by kind (fixed values).
REFERENT = ("person", "organization", "place", "event", "creative_work", "product", "object", "law", "award", "other_referent")
CATEGORY = ("occupation", "nationality", "religion", "language", "field", "genre", "medical_condition", "species", "concept")
LITERAL = ("date", "time", "number", "ordinal", "percentage", "money", "quantity", "other_literal")


def parse_extractions(raw: DataFrame) -> DataFrame:
    """(doc_id, facts, error) of model responses (doc_id, response): JSON ``{"facts": [...]}``.

    The kind of a mention follows from its type alone. An empty text, relation or name, or an unknown
    type, rejects the whole response.
    """
    parsed = raw.select("doc_id", F.from_json(F.get_json_object("response", "$.facts"), FACT_JSON).alias("f"))
    kind = lambda t: F.when(t.isin(*REFERENT), "referent").when(t.isin(*CATEGORY), "category").when(t.isin(*LITERAL), "literal").when(t == "unknown", "uncertain")
    clean = F.transform("f", lambda x: F.struct(F.trim(x["text"]).alias("text"), F.trim(x["relation"]).alias("relation"), F.transform(x["mentions"], lambda m: F.struct(F.trim(m["name"]).alias("name"), kind(m["type"]).alias("kind"), m["type"].alias("type"))).alias("mentions")))
    filled = lambda c: c.isNotNull() & (c != "")
    good = F.forall("c", lambda x: filled(x["text"]) & filled(x["relation"]) & F.coalesce(F.forall(x["mentions"], lambda m: filled(m["name"]) & m["kind"].isNotNull()), F.lit(False)))
    checked = parsed.withColumn("c", clean)
    error = F.when(F.col("f").isNull(), "unreadable").when(~good, "invalid")
    return checked.select("doc_id", F.when(error.isNull(), F.col("c")).alias("facts"), error.alias("error"))


def extraction_report(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy(F.coalesce("error", F.lit("ok")).alias("status")).agg(F.count("*").alias("n_documents"), F.sum(F.coalesce(F.size("facts"), F.lit(0))).alias("n_facts"))


def answer_questions(ranked: DataFrame, questions: DataFrame, documents: DataFrame, reader: Reader, k: int = 5) -> DataFrame:
    """(query, prediction): the reader's answer from the texts of the k best documents.

    ``ranked(query, doc, rank)``, ``questions(query, question)``, ``documents(doc, text)``.
    """
    top = ranked.where(F.col("rank") <= k).join(documents.select("doc", "text"), "doc")
    packed = top.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("context"))
    rows = questions.select("query", "question").join(packed, "query", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = reader([(q, c if isinstance(c, str) else "") for q, c in zip(pdf["question"], pdf["context"])])
            yield pd.DataFrame({"query": pdf["query"], "prediction": [a or "unknown" for a in answers]})

    return rows.mapInPandas(run, "query string, prediction string")
