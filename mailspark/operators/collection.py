"""The vector collection and the ledger of embedded emails, as parquet tables.

Every batch adds a ``batch=<n>`` folder to each table and, last of all, a row to
``commits``; readers see committed batches only. ``replaced`` names the chunks a
batch makes obsolete, so a reader filters by a short list instead of looking up
the state of every chunk. Chunks lie in a folder per bucket of their thread, so that a
filter on one thread reads the files of one bucket. Nothing is deleted or rewritten: a failed or repeated
batch leaves no trace, and an update costs the changed threads alone.
``compact`` folds the batches and empties the list.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark.config import MailConfig
from mailspark.operators.search import filter_collection
from mailspark.operators.skew import KeySet
from mailspark.schemas import COLLECTION
from mailspark.session import read_table
from mailspark.sources.models import model

_THREAD = T.StructField("thread_id", T.StringType())
_BATCH = T.StructField("batch", T.LongType())
_BUCKET = T.StructField("bucket", T.IntegerType())
# Part of the layout on disk.
BUCKETS = 64
# Filters that name a thread; in a chunk both are its thread.
_THREAD_KEYS = ("thread_id", "metadata.thread_id")
_PARTS = {
    "manifest": T.StructType([
        T.StructField("name", T.StringType()), T.StructField("embed_model", T.StringType()), T.StructField("dim", T.IntegerType()),
    ]),
    "commits": T.StructType([_BATCH]),
    "chunks": T.StructType([*COLLECTION.fields, _BUCKET, _BATCH]),
    "live": T.StructType([_THREAD, _BATCH]),
    # Chunks of (thread_id, obsolete) do not count any more.
    "replaced": T.StructType([_THREAD, T.StructField("obsolete", T.LongType()), _BATCH]),
    "failed": T.StructType([_THREAD, _BATCH]),
    "embedded": T.StructType([_THREAD, T.StructField("id", T.StringType()), _BATCH]),
}


def replace_threads(stored: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """Stored rows of unchanged threads, and the new rows of the changed ones."""
    return stored.join(changed.select("thread_id"), "thread_id", "left_anti").unionByName(new)


def mark_embedded(emails: DataFrame, embedded: DataFrame) -> DataFrame:
    """``is_embedded`` as the ledger of ``(id)`` says, on top of what is stored."""
    ledger = embedded.select("id").distinct().withColumn("_done", F.lit(True))
    done = F.col("is_embedded") | F.coalesce("_done", F.lit(False))
    return emails.join(ledger, "id", "left").withColumn("is_embedded", F.coalesce(done, F.col("_done"))).drop("_done")


def _bucket(thread_id: Column) -> Column:
    return F.pmod(F.xxhash64(thread_id), F.lit(BUCKETS)).cast("int")


class Collection:
    """One collection below a root folder all executors share."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark = spark
        self.path = f"{root.rstrip('/')}/{name}"
        self.name = name

    def create(self, embed_model: str) -> None:
        """Records the model; a second call must name the same one."""
        found = self._read("manifest").collect()
        if not found:
            row = [(self.name, embed_model, model(embed_model)[2])]
            frame = self.spark.createDataFrame(row, _PARTS["manifest"])
            frame.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest")
        elif found[0]["embed_model"] != embed_model:
            raise ValueError(f"collection {self.name} was made with {found[0]['embed_model']}")

    def _read(self, part: str) -> DataFrame:
        return read_table(self.spark, f"{self.path}/{part}", _PARTS[part])

    def _write(self, df: DataFrame, part: str, batch: int) -> None:
        # Overwriting its own folder makes a repeated batch harmless.
        df.write.mode("overwrite").parquet(f"{self.path}/{part}/batch={batch}")

    def _committed(self, part: str, but: int | None = None) -> DataFrame:
        """Rows of committed batches. Commits are joined, since their number grows."""
        commits = self._read("commits").select("batch").distinct()
        if but is not None:
            commits = commits.where(F.col("batch") != but)
        return self._read(part).join(commits, "batch", "left_semi")

    def write_batch(
        self, batch: int, chunks: DataFrame, changed: DataFrame, embedded: DataFrame, small: int = MailConfig.small_keys,
    ) -> None:
        """Replaces the changed threads by ``chunks`` (a thread may have none)
        and records the emails that went into them.

        A thread with a chunk that got no embedding keeps its old chunks and
        stays pending; the others go on.
        """
        dealt = chunks.select(*COLLECTION.names, _bucket(F.col("thread_id")).alias("bucket"))
        # Few files per bucket, and a bucket with a large thread in several.
        dealt.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/chunks/batch={batch}")
        # Read back, since computing them again would ask the model again.
        written = self._read("chunks").where(F.col("batch") == batch)
        self._write(written.where(F.col("embedding").isNull()).select("thread_id").distinct(), "failed", batch)
        failed = KeySet(self._read("failed").where(F.col("batch") == batch), "thread_id", small)
        done = failed.outside(changed.select("thread_id").distinct())
        self._write(done, "live", batch)
        now = KeySet(self._read("live").where(F.col("batch") == batch), "thread_id", small)
        before = now.inside(self._committed("live", but=batch)).select("thread_id", F.col("batch").alias("obsolete"))
        this = failed.inside(changed.select("thread_id").distinct()).select("thread_id", F.lit(batch).cast("bigint").alias("obsolete"))
        self._write(before.unionByName(this).distinct(), "replaced", batch)
        self._write(failed.outside(embedded.select("thread_id", "id")), "embedded", batch)
        self._commit(batch)

    def _commit(self, batch: int) -> None:
        self._write(self.spark.range(1).select(F.lit(1).alias("done")).coalesce(1), "commits", batch)

    def embedded(self) -> DataFrame:
        return self._committed("embedded").select("thread_id", "id")

    def failed_in(self, batch: int) -> DataFrame:
        """``(_failed)``: the threads that failed in one batch."""
        return self._read("failed").where(F.col("batch") == batch).select(F.col("thread_id").alias("_failed"))

    def failed_threads(self) -> DataFrame:
        """Threads whose last attempt failed."""
        lost = self._committed("failed").groupBy("thread_id").agg(F.max("batch").alias("lost"))
        won = self._committed("live").groupBy("thread_id").agg(F.max("batch").alias("won"))
        return lost.join(won, "thread_id", "left").where(F.col("won").isNull() | (F.col("won") < F.col("lost"))).select("thread_id")

    def read(self, small: int = MailConfig.small_keys) -> DataFrame:
        """The current chunks: one scan while few have been replaced since the
        last compaction, a join when there are many."""
        return self._current(F.lit(True), small)

    def find(
        self, filters: Mapping[str, object], limit: int | None = None, order: Sequence[str] = (), small: int = MailConfig.small_keys,
    ) -> DataFrame:
        """Current chunks that match every filter; ``limit`` takes the first in ``order``.
        A filter on a thread leaves the folders of its bucket alone."""
        named = [filters[key] for key in _THREAD_KEYS if filters.get(key) is not None]
        here = F.lit(True)
        for thread in named:
            here = here & (F.col("bucket") == _bucket(F.lit(thread).cast("string")))
        return filter_collection(self._current(here, small), filters, limit, order)

    def _current(self, where: Column, small: int) -> DataFrame:
        chunks = self._committed("chunks").where(where)
        replaced = self._committed("replaced").select("thread_id", F.col("obsolete").alias("batch"))
        few = replaced.limit(small + 1).collect()
        if not few:
            return chunks.select(*COLLECTION.names)
        if len(few) <= small:
            replaced = F.broadcast(self.spark.createDataFrame(few, replaced.schema))
        return chunks.join(replaced, ["thread_id", "batch"], "left_anti").select(*COLLECTION.names)

    def compact(self, target: Collection, batch: int = 0) -> None:
        """Writes the current state into another collection as one batch, with the
        model, and with the failed threads in a batch after it."""
        for row in self._read("manifest").collect():
            target.create(row["embed_model"])
        target.write_batch(batch, self.read(), self._committed("live"), self.embedded())
        target._write(self.failed_threads(), "failed", batch + 1)
        target._commit(batch + 1)
