"""Metadata filters and similarity search over a collection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(filters: Mapping[str, object]) -> Column:
    """All of ``{"metadata.thread_id": "…", …}`` hold."""
    condition = F.lit(True)
    for key, value in filters.items():
        condition = condition & (F.col(key) == F.lit(value))
    return condition


def filter_collection(collection: DataFrame, filters: Mapping[str, object], limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Rows that match every filter; ``limit`` takes the first in ``order``."""
    found = collection.where(matches(filters))
    if order:
        found = found.orderBy(*order)
    return found if limit is None else found.limit(limit)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine similarity to a fixed vector, in double precision."""
    fixed = F.array(*[F.lit(float(x)) for x in query])
    norm = float(sum(float(x) * float(x) for x in query)) ** 0.5
    doubles = vector.cast("array<double>")
    add = lambda total, x: total + x
    dot = F.aggregate(F.zip_with(doubles, fixed, lambda a, b: a * b), F.lit(0.0), add)
    squares = F.aggregate(F.transform(doubles, lambda a: a * a), F.lit(0.0), add)
    length = F.sqrt(squares) * norm
    return F.when(length > 0, dot / length).otherwise(0.0)


def top_k(
    collection: DataFrame, query: Sequence[float], k: int, filters: Mapping[str, object] | None = None,
    vector: str = "embedding", tie: str = "chunk_no",
) -> DataFrame:
    """The ``k`` most similar rows: one scan, k rows per task, no shuffle."""
    found = collection.where(matches(filters or {}))
    scored = found.withColumn("score", cosine(F.col(vector), query))
    return scored.orderBy(F.desc("score"), tie).limit(k)
