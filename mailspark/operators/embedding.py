"""Embedding of chunks by a pluggable function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mailspark.functions.text import words

# An embedder turns a text column into an ARRAY<FLOAT> column.
Embedder = Callable[[Column], Column]


def fast_hash(token: Column) -> Column:
    return F.xxhash64(token)


def portable_hash(token: Column) -> Column:
    """A hash other engines can recompute: 32 bits of MD5."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")


def hashed_terms(dim: int, hash_token: Callable[[Column], Column] = fast_hash) -> Embedder:
    """Term counts hashed into ``dim`` slots, scaled to unit length.

    It stands in for a model. Tokens are hashed in the JVM; the counting of a
    batch is one numpy call per text.
    """
    @F.pandas_udf("array<float>")
    def count(slots: pd.Series) -> pd.Series:
        def one(indexes):
            counts = np.bincount(indexes, minlength=dim) if len(indexes) else np.zeros(dim)
            norm = np.sqrt((counts * counts).sum())
            return (counts / norm if norm else counts).astype(np.float32)

        return slots.map(one)

    return lambda text: count(F.transform(words(text), lambda t: F.pmod(hash_token(t), F.lit(dim)).cast("int")))


def model_embedder(load: Callable[[], Callable[[list[str]], list]], batch: int = 64) -> Embedder:
    """An embedder around a real model, loaded once per task.

    A text the model fails on gets NULL, which keeps its thread pending.
    """
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def attempt(texts: list[str]) -> list:
            try:
                return [np.asarray(vector, dtype=np.float32) for vector in model(texts)]
            except Exception:
                if len(texts) == 1:
                    return [None]
                return [vector for text in texts for vector in attempt([text])]

        for texts in batches:
            vectors = []
            for start in range(0, len(texts), batch):
                vectors.extend(attempt(list(texts.iloc[start:start + batch])))
            yield pd.Series(vectors, dtype="object")

    # The evaluated hints, since the module's annotations are strings.
    embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(embed, "array<float>")
