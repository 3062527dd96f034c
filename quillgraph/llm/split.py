"""Splitting oversized texts at natural boundaries.

A token is a piece between Unicode white space. For each text longer than its
limit the token offsets (start and end of every token, a running sum over the
text) and the sorted array of boundary positions are computed once; each cut
is then a binary search for the last boundary at or under the limit. The next
piece steps back by the overlap. Where no boundary gives progress the text is
cut hard at the limit.

Defined results
* null, empty and blank texts: one piece with zero tokens and the text as it is;
* a text at or under the limit: one piece, the unchanged text;
* a limit that is null or under 1 takes the default; an overlap that is null
  takes the default, a negative one is 0, one at or over the limit is limit - 1;
* repeated rows are split separately; other columns are ignored, so clashing
  names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import broadcast_if_small

DEFAULT_SIZE = 512
DEFAULT_OVERLAP = 64

#: Characters with the Unicode property White_Space, as a Java and Python character class.
SPACE_CLASS = r"[\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
TOKEN_CLASS = SPACE_CLASS.replace("[", "[^", 1)

_TOKEN = re.compile(TOKEN_CLASS + "+")
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'’”»)\]}]*$")
_INITIAL = re.compile(r"^[(\"'“„]*[^\W\d_]\.$")
#: Abbreviations after which a full stop ends no sentence (fixed values).
ABBREVIATIONS = frozenset("mr. mrs. ms. dr. prof. st. sir. capt. rev. hon. jr. sr. jnr. no. vol. fig. cf. vs. e.g. i.e. b. d. c. bzw. z.b. sra. mme. mlle.".split())
_PARAGRAPH_GAP = re.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:\r\n?|\n)|\u2029")
_CLOSING_TAG = re.compile(r"(?:</p>|<br\s*/?>)\s*$", re.IGNORECASE)

PIECES = "doc_id bigint, piece_no int, start_token int, end_token int, n_pieces int, cut string, piece string"


def boundaries(text: str, starts: list[int], ends: list[int]) -> tuple[list[int], list[bool]]:
    """Token counts after which a paragraph or sentence ends, ascending, and which end a paragraph."""
    at: list[int] = []
    paragraph: list[bool] = []
    n = len(starts)
    for i in range(n - 1):
        gap = text[ends[i] : starts[i + 1]]
        if (len(gap) > 1 or gap == "\u2029") and _PARAGRAPH_GAP.search(gap):
            at.append(i + 1)
            paragraph.append(True)
            continue
        token = text[starts[i] : ends[i]]
        if _CLOSING_TAG.search(token):
            at.append(i + 1)
            paragraph.append(True)
        elif _SENTENCE_END.search(token) and not _INITIAL.match(token) and token.lower() not in ABBREVIATIONS:
            at.append(i + 1)
            paragraph.append(False)
    return at, paragraph


def cut_points(n: int, size: int, overlap: int, at: list[int]) -> list[tuple[int, int]]:
    """(start, end) token ranges: each at most ``size`` long, sharing ``overlap`` with the one before."""
    if n <= size:
        return [(0, n)]
    out = []
    start = 0
    while True:
        limit = start + size
        if limit >= n:
            out.append((start, n))
            return out
        k = bisect_right(at, limit) - 1
        # a boundary inside the overlap would repeat the last piece and make no progress
        end = at[k] if k >= 0 and at[k] > start + overlap else limit
        out.append((start, end))
        start = end - overlap


def split_text(text: str, size: int, overlap: int) -> list[tuple[int, int, str, str]]:
    """(start_token, end_token, kind of cut, piece) of one text."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    n = len(spans)
    if n <= size:
        return [(0, n, "whole", text)]
    starts = [s for s, _ in spans]
    ends = [e for _, e in spans]
    at, paragraph = boundaries(text, starts, ends)
    kind = dict(zip(at, paragraph))
    out = []
    for a, b in cut_points(n, size, overlap, at):
        cut = "end" if b == n else ("paragraph" if kind[b] else "sentence") if b in kind else "hard"
        out.append((a, b, cut, text[starts[a] : ends[b - 1]]))
    return out


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["doc_id", "piece_no", "start_token", "end_token", "n_pieces", "cut", "piece"]
    for pdf in batches:
        rows = []
        for doc_id, text, size, overlap in zip(pdf["doc_id"], pdf["text"], pdf["size"], pdf["overlap"]):
            pieces = split_text(text, int(size), int(overlap))
            for i, (a, b, cut, piece) in enumerate(pieces):
                rows.append((doc_id, i, a, b, len(pieces), cut, piece))
        out = pd.DataFrame(rows, columns=columns)
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def with_limits(documents: DataFrame, config: DataFrame) -> DataFrame:
    """(doc_id, text, size, overlap): each document with the limits valid for its source."""
    sized = (
        config.where("source is not null")
        .groupBy("source")
        .agg(F.min(F.when(F.col("chunk_size") >= 1, F.col("chunk_size"))).alias("_size"), F.min("chunk_overlap").alias("_overlap"))
    )
    size = F.coalesce("_size", F.lit(DEFAULT_SIZE))
    overlap = F.greatest(F.lit(0), F.least(F.coalesce("_overlap", F.lit(DEFAULT_OVERLAP)), size - 1))
    return (
        documents.select("doc_id", "text", F.col("source").alias("_source"))
        .join(broadcast_if_small(sized.withColumnRenamed("source", "_source")), "_source", "left")
        .select("doc_id", "text", size.cast("int").alias("size"), overlap.cast("int").alias("overlap"))
    )


def over_limit(limited: DataFrame) -> DataFrame:
    """Rows whose text has more tokens than ``size``.

    A text of fewer than 2 * size + 1 characters cannot have that many tokens, so most rows
    are decided by their length; the rest count their tokens inside the JVM.
    """
    tokens = F.size(F.split(F.regexp_replace("text", f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", ""), f"{SPACE_CLASS}+"))
    return limited.where((F.length("text") >= 2 * F.col("size") + 1) & (tokens > F.col("size")))


def split_oversized(documents: DataFrame, config: DataFrame) -> DataFrame:
    """Pieces of the documents that exceed their limit; no shuffle, Python only for those texts."""
    return over_limit(with_limits(documents, config)).mapInPandas(_split_batches, PIECES)


def split_documents(documents: DataFrame, config: DataFrame) -> DataFrame:
    """Pieces of every document; a text within its limit is one unchanged piece."""
    limited = with_limits(documents, config)
    tokens = F.coalesce(F.regexp_count("text", F.lit(f"{TOKEN_CLASS}+")), F.lit(0)).cast("int")
    counted = limited.withColumn("_n", tokens)
    whole = counted.where("_n <= size").select(
        "doc_id", F.lit(0).alias("piece_no"), F.lit(0).alias("start_token"), F.col("_n").alias("end_token"), F.lit(1).alias("n_pieces"), F.lit("whole").alias("cut"), F.col("text").alias("piece")
    )
    return whole.unionByName(over_limit(limited).mapInPandas(_split_batches, PIECES))
