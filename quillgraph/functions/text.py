"""Text scalars: normalisers, chunk windows, stable ids, kinship inversion."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters with the Unicode property White_Space, for Java patterns.
SPACE = r"[\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def collapse(text: Column) -> Column:
    """Runs of Unicode white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


@F.pandas_udf(StringType())
def _nfkc_fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()))


def _when_ascii(text: Column, plain: Column, other) -> Column:
    """``plain`` for ASCII rows; only the rest carries its text into Python."""
    ascii_ = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_, plain).otherwise(other(F.when(~ascii_, text)))


def norm(text: Column) -> Column:
    """NFKC, case folding, white space collapsed: the key under which names are equal."""
    return _when_ascii(text, F.lower(collapse(text)), _nfkc_fold)


def display_name(text: Column) -> Column:
    """NFC and white space collapsed: the spelling that is shown."""
    return _when_ascii(text, collapse(text), _nfc)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda t: t != "")


def chunk_windows(documents: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(doc_id, chunk_start, n_tokens, chunk): fixed windows of white-space tokens.

    A text within ``size`` is one unchanged chunk; a longer one gives a window at every multiple of
    ``size - overlap`` below its length. Null texts give no chunk.
    """
    step = size - overlap
    counted = documents.where("text is not null").select("doc_id", "text", tokens(F.col("text")).alias("_t")).withColumn("_n", F.size("_t"))
    if step < 1:
        counted = counted.withColumn("_n", F.when(F.col("_n") > size, F.raise_error(F.lit("overlap must be smaller than size"))).otherwise(F.col("_n")))
    starts = F.when(F.col("_n") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(max(1, step))))
    windows = counted.select("doc_id", "text", "_t", "_n", F.explode(starts).alias("chunk_start"))
    chunk = F.when(F.col("_n") <= size, F.col("text")).otherwise(F.array_join(F.slice("_t", F.col("chunk_start") + 1, F.lit(size)), " "))
    return windows.select("doc_id", "chunk_start", F.least(F.lit(size), F.col("_n") - F.col("chunk_start")).alias("n_tokens"), chunk.alias("chunk"))


def stable_id(prefix: str, digits: int, **fields: Column) -> Column:
    """``prefix`` and the first hex digits of the SHA-256 of the compact JSON with sorted keys."""
    doc = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.concat(F.lit(prefix), F.substring(F.sha2(doc, 256), 1, digits))


def spaced_digest(**fields: Column) -> Column:
    """SHA-256 in hex of the JSON with sorted keys, a blank after every colon and comma between the fields."""
    def member(k: str) -> Column:
        whole = F.to_json(F.struct(fields[k].alias(k)), {"ignoreNullFields": "false"})  # {"k":value}
        head = len(f'{{"{k}":')
        return F.concat(F.lit(f'"{k}": '), F.substring(whole, F.lit(head + 1), F.length(whole) - F.lit(head + 1)))

    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *[member(k) for k in sorted(fields)]), F.lit("}")), 256)


#: Kinship words that a relation label may name, and words that may stand before one (fixed values).
ROLES = (
    "mother father parent son daughter child wife husband spouse brother sister sibling uncle aunt nephew niece "
    "grandfather grandmother grandparent grandson granddaughter grandchild great-grandfather great-grandmother "
    "great-grandparent great-grandson great-granddaughter great-grandchild"
).split()
MODIFIERS = (
    "first second third fourth fifth sixth seventh eighth eldest oldest elder older youngest younger full half only "
    "maternal paternal biological adoptive"
).split()
#: Generation above and below: the only roles whose inverse is a plain role (fixed values).
_UP, _DOWN = ("mother", "father", "parent"), ("son", "daughter", "child")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def role_inverse(relation: Column) -> Column:
    """Inverse of a kinship label, without guessing a gender; null for any other label.

    The label is read as [verb] [article] phrase [preposition]; the phrase is modifiers and one role.
    """

    def read(words: Column) -> Column:
        verb = F.when(F.get(words, F.lit(0)).isin("is", "was", "has", "had"), F.get(words, F.lit(0))).otherwise("")
        rest = F.when(verb == "", words).otherwise(F.slice(words, 2, F.size(words)))
        rest = _let(rest, lambda r: F.when(F.get(r, F.lit(0)).isin("a", "an", "the"), F.slice(r, 2, F.size(r))).otherwise(r))
        return _let(F.struct(verb.alias("verb"), rest.alias("rest")), phrase_of)

    def phrase_of(x: Column) -> Column:
        last = F.try_element_at(x["rest"], F.lit(-1))
        without = F.slice(x["rest"], 1, F.greatest(F.size(x["rest"]) - 1, F.lit(0)))
        phrase = F.when(x["verb"].isin("has", "had"), x["rest"]).when(last.isin("of", "to"), without).otherwise(F.array().cast("array<string>"))
        return _let(F.struct(x["verb"].alias("verb"), last.alias("last"), phrase.alias("phrase")), invert)

    def invert(x: Column) -> Column:
        phrase, verb = x["phrase"], x["verb"]
        role = F.try_element_at(phrase, F.lit(-1))
        kin = role.isin(*ROLES) & F.forall(F.slice(phrase, 1, F.greatest(F.size(phrase) - 1, F.lit(0))), lambda w: w.isin(*MODIFIERS))
        past = verb.isin("was", "had")
        be, have = F.when(past, "was").otherwise("is"), F.when(past, "had").otherwise("has")
        spoken = F.array_join(phrase, " ")
        bare = (F.size(phrase) == 1) & (x["last"] == "of")
        inverse = (
            F.when(verb.isin("has", "had"), F.concat_ws(" ", be, spoken, F.lit("of")))
            .when(bare & role.isin(*_UP), F.concat_ws(" ", be, F.lit("child of")))
            .when(bare & role.isin(*_DOWN), F.concat_ws(" ", be, F.lit("parent of")))
            .otherwise(F.concat_ws(" ", have, F.lit("as"), spoken))
        )
        return F.when(kin, inverse)

    return _let(F.split(F.lower(collapse(relation)), " "), read)


_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def answer_tokens(text: Column) -> Column:
    """Words of a short answer: lower case, no ASCII punctuation, no articles."""
    bare = F.translate(F.lower(text), _PUNCTUATION, "")
    return F.filter(tokens(bare), lambda t: ~t.isin("a", "an", "the"))
