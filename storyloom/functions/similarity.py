"""Similarity: token overlap and cosine as expressions; Ratcliff-Obershelp and hash embeddings as Arrow-batched functions."""

from __future__ import annotations

import difflib
import hashlib
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .text import col


@pandas_udf(T.DoubleType())
def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """The Ratcliff-Obershelp ratio of two texts; 0 if either is blank."""

    def one(a: str | None, b: str | None) -> float:
        a, b = (a or "").strip(), (b or "").strip()
        return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0

    return pd.Series([one(a, b) for a, b in zip(left, right)], dtype="float64")


def shared_letters(left: Column | str, right: Column | str) -> Column:
    """How many characters two texts share, each as often as both have it: twice this over both lengths bounds the ratio from above."""
    a, b = col(left), col(right)
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(count(a, c), count(b, c))))


def overlap_score(query: Column | str, text: Column | str) -> Column:
    """Of two token sets: their overlap plus its share of each, rounded to six places; 0 if either is empty."""
    q, t = col(query), col(text)
    both = F.size(F.array_intersect(q, t)).cast("double")
    return F.when((F.size(q) > 0) & (F.size(t) > 0), F.round(both + both / F.size(q) + both / F.size(t), 6)).otherwise(F.lit(0.0))


def jaccard(left: Column | str, right: Column | str) -> Column:
    """The Jaccard similarity of two token sets; 0 if either is empty."""
    a, b = col(left), col(right)
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, v: a + v)


def cosine(left: Column | str, right: Column | str) -> Column:
    """The cosine of two vectors; null if either has no length."""
    a, b = col(left), col(right)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def hash_embedding(dim: int = 384):
    """A function of token arrays: signed counts of hashed tokens, at unit length (an empty list gives zeros)."""

    @pandas_udf(T.ArrayType(T.FloatType()))
    def embed(tokens: pd.Series) -> pd.Series:
        def one(words) -> list[float]:
            out = [0.0] * dim
            for w in words if words is not None else ():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                out[struct.unpack(">I", h[:4])[0] % dim] += 1.0 if h[4] % 2 == 0 else -1.0
            size = sum(v * v for v in out) ** 0.5
            return [v / size for v in out] if size else out

        return pd.Series([one(w) for w in tokens])

    return embed
