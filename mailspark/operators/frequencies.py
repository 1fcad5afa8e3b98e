"""How many documents of a corpus hold a word, and the weight that follows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailspark.functions.text import words
from mailspark.operators.skew import KeySet
from mailspark.session import stored

# Weights are whole thousandths, so that their sums do not depend on order.
_SCALE = 1000


def document_frequencies(documents: DataFrame, small: int) -> DataFrame:
    """``(word, documents)`` of ``(thread_id, segment, text)``.

    A text gives each of its words once, counted before the shuffle. Only the words of
    threads in segments meet per thread first.
    """
    held = documents.select("thread_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    several = KeySet(documents.where("segment > 0").select("thread_id").distinct(), "thread_id", small)
    if not several.empty:
        held = several.outside(held).unionByName(several.inside(held).distinct())
    return held.groupBy("word").agg(F.count("*").alias("documents"))


class WordWeights:
    """Inverse document frequencies: ``ln((1 + N) / (1 + documents))`` in thousandths.

    The ``small`` most frequent words are broadcast. The others are joined by word, and
    none of them fills more than one part in ``small`` of the rows that are left. A word
    the corpus does not have gets the weight of one in no document.
    """

    def __init__(self, documents: DataFrame, small: int):
        self.small = small
        self.number = documents.select("thread_id").distinct().count()
        counts = document_frequencies(documents, small)
        odds = F.lit(1.0 + self.number) / (F.col("documents") + 1)
        self.table = stored(counts.withColumn("weight", F.floor(F.log(odds) * _SCALE)), "frequencies")
        frequent = self.table.orderBy(F.desc("documents"), "word").limit(small + 1).collect()
        self.whole = len(frequent) <= small
        self.frequent = documents.sparkSession.createDataFrame(frequent[:small], self.table.schema).select("word", "weight")

        self.unknown = math.floor(math.log(1.0 + self.number) * _SCALE)

    def local(self) -> tuple[pa.Array, np.ndarray]:
        """The frequent words, ``small`` at most, and their weights."""
        found = self.frequent.toArrow().combine_chunks()
        words_ = found.column("word").combine_chunks().cast(pa.string())
        return words_, found.column("weight").to_numpy()

    def rare(self, rows: DataFrame) -> DataFrame:
        """``rows`` whose ``word`` is known but not frequent, with its ``weight``."""
        rest = rows.join(F.broadcast(self.frequent.select("word")), "word", "left_anti")
        return rest.join(self.table.select("word", "weight"), "word")

    def weigh(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the ``weight`` of their ``word``; 0 where that is NULL."""
        unknown = F.floor(F.log(F.lit(1.0 + self.number)) * _SCALE)
        weight = F.when(F.col("word").isNull(), 0).otherwise(F.coalesce("weight", unknown))
        found = rows.join(F.broadcast(self.frequent), "word", "left")
        if self.whole:
            return found.withColumn("weight", weight)
        # Rows are told apart by what they found, not by a second lookup.
        met = F.col("weight").isNotNull() | F.col("word").isNull()
        rare = found.where(~met).drop("weight").join(self.table.select("word", "weight"), "word", "left")
        return found.where(met).unionByName(rare).withColumn("weight", weight)
