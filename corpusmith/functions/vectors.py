"""Vector functions on array columns, in double precision."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..errors import SetupError

#: Buckets of the hashing embedder: the last byte of a token's SHA-1.
BUCKETS = 256


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def finite(v: Column) -> Column:
    """NaN and infinite components become 0."""
    return F.transform(_doubles(v), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))


def l2_normalise(v: Column) -> Column:
    """Unit length after non-finite components become 0; a zero vector stays."""
    safe = finite(v)
    length = norm(safe)
    return F.transform(safe, lambda x: x / F.when(length == 0, 1.0).otherwise(length))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


@lru_cache(maxsize=200_000)
def _bucket(token: str) -> int:
    return hashlib.sha1(token.encode(), usedforsecurity=False).digest()[-1]


@F.pandas_udf(ArrayType(DoubleType()))
def _hashed(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> np.ndarray | None:
        if text is None:
            return None
        found = np.fromiter(map(_bucket, re.findall(r"[a-z0-9]+", text.lower())), np.int64)
        counts = np.bincount(found, minlength=BUCKETS).astype(float)
        return counts / (np.linalg.norm(counts) or 1.0)

    return texts.map(one)


def hash_embedding(text: Column) -> Column:
    """Counts of the text's ASCII tokens by bucket (the last byte of the token's SHA-1), at unit length: the
    deterministic offline embedder. Arrow batches; a histogram has no cheap form in array functions."""
    return _hashed(text)


Embedder = Callable[[Column], Column]


def with_instruction(embed: Embedder, instruction: str) -> Embedder:
    """An embedder of questions from one of documents: the instruction stands before each question; null stays null."""
    return lambda text: embed(F.concat(F.lit(instruction), text))


def first_that_loads(*loaders: Callable[[], Embedder]) -> Embedder:
    """The first embedder whose loader succeeds, the preferred one first. A loader fails by raising ImportError (its
    package is not here), OSError (its files are not) or RuntimeError (its device is not); SetupError if all do."""
    reasons = []
    for load in loaders:
        try:
            return load()
        except (ImportError, OSError, RuntimeError) as error:
            reasons.append(f"{getattr(load, '__name__', load)}: {error}")
    raise SetupError(f"no embedder loads ({'; '.join(reasons)})")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@F.pandas_udf(DoubleType())
def _held_words(query: pd.Series, passage: pd.Series) -> pd.Series:
    asked = lru_cache(maxsize=1024)(lambda text: frozenset(_WORD.findall(text)))
    return pd.Series([None if p is None else 0.0 if q is None else float(sum(map(asked(q).__contains__, _WORD.findall(p)))) for q, p in zip(query, passage, strict=True)], dtype="float64")


def overlap_score(query: Column, passage: Column) -> Column:
    """How many words of the passage, repeats counted, are words of the query: the deterministic offline reranker."""
    return _held_words(F.lower(query), F.lower(passage))


@F.pandas_udf(ArrayType(DoubleType()))
def _held_words_of_each(queries: pd.Series, passage: pd.Series) -> pd.Series:
    def one(texts: np.ndarray, p: str | None) -> list[float | None]:
        if p is None:
            return [None] * len(texts)
        held = Counter(_WORD.findall(p))
        return [0.0 if q is None else float(sum(held.get(w, 0) for w in set(_WORD.findall(q)))) for q in texts]

    return pd.Series([one(q, p) for q, p in zip(queries, passage, strict=True)])


def overlap_scores(queries: Column, passage: Column) -> Column:
    """``overlap_score`` of each of an array of queries, for which the passage is lower-cased and split once."""
    return _held_words_of_each(F.transform(queries, F.lower), F.lower(passage))


overlap_score.many = overlap_scores
