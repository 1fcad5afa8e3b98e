"""From raw messages to stored ``emails`` and ``attachments`` rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark.config import MailConfig
from mailspark.operators.id_index import IdIndex
from mailspark.operators.ingest import attachments_from, emails_from, message_rows, message_thread, usable_messages
from mailspark.operators.skew import KeySet, small_keys
from mailspark.schemas import ATTACHMENTS, EMAILS
from mailspark.session import entries, read_table, scratch_scope, stored
from mailspark.sources.headers import Source

_BATCH = [T.StructField("writer", T.StringType()), T.StructField("batch", T.LongType())]
_BUCKET = T.StructField("bucket", T.IntegerType())
_SCHEMAS = {
    "emails": T.StructType([*EMAILS.fields, _BUCKET, *_BATCH]),
    "attachments": T.StructType([*ATTACHMENTS.fields, _BUCKET, *_BATCH]),
    "rejected": T.StructType([T.StructField("place", T.StringType()), T.StructField("error", T.StringType()), *_BATCH]),
    "commits": T.StructType([
        T.StructField("emails", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("parsed", T.LongType()), *_BATCH]),
}


class MailStore:
    """The mail tables below a root folder all executors share.

    Every load is a batch of a writer. A writer is one stream, as long as its
    checkpoint lives, or one single load. A batch owns a folder in each table and
    counts once its commit row is there, which is written last: readers see
    committed batches only, a failed batch leaves nothing to be seen, and one that
    is run again after its commit does nothing. No batch overwrites another's rows.

    Rows are sorted by a hash bucket of the thread, so the rows of a few threads
    are found by the statistics of row groups instead of a full scan. Whether a message
    is new is asked of an index of ids, which opens the buckets of the batch alone.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 1024):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self.ids = IdIndex(spark, f"{self.root}/ids", self.committed)

    def _bucket(self, thread_id: Column) -> Column:
        return F.pmod(F.xxhash64(thread_id), F.lit(self.buckets)).cast("int")

    def _read(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.root}/{name}", _SCHEMAS[name])

    def _table(self, name: str) -> DataFrame:
        """Rows of committed batches. Commits are joined, since their number grows."""
        commits = self._read("commits").select("writer", "batch").distinct()
        return self._read(name).join(commits, ["writer", "batch"], "left_semi")

    def emails(self) -> DataFrame:
        return self._table("emails").select(*EMAILS.names)

    def attachments(self) -> DataFrame:
        return self._table("attachments").select(*ATTACHMENTS.names)

    def rejected(self) -> DataFrame:
        """Where messages stood that could not be read, and why."""
        return self._table("rejected").select("place", "error")

    def arrivals(self) -> DataFrame:
        """A stream of commits. It wakes the embedding after a batch can be read."""
        return self.spark.readStream.schema(_SCHEMAS["commits"]).parquet(f"{self.root}/commits")

    def threads_of(self, commits: DataFrame) -> DataFrame:
        """``(thread_id)`` of the emails that came with these commits."""
        ours = commits.select("writer", "batch").distinct()
        return self._read("emails").join(ours, ["writer", "batch"], "left_semi").select("thread_id").distinct()

    def near_threads(self, threads: DataFrame, small: int = MailConfig.small_keys) -> tuple[DataFrame, DataFrame]:
        """Emails and attachments of the buckets the threads fall into; all of
        them if the threads are many."""
        local, _ = small_keys(threads, "thread_id", small)
        if local is None:
            return self.emails(), self.attachments()
        buckets = [row[0] for row in local.select(self._bucket(F.col("thread_id"))).distinct().collect()]
        hit = F.col("bucket").isin(buckets)
        emails, attachments = self._table("emails").where(hit), self._table("attachments").where(hit)
        return emails.select(*EMAILS.names), attachments.select(*ATTACHMENTS.names)

    def _write(self, rows: DataFrame, name: str, writer: str, batch: int) -> None:
        # Only this batch's own folder, which no reader sees before the commit.
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/writer={writer}/batch={batch}")

    def _write_sorted(self, rows: DataFrame, name: str, writer: str, batch: int) -> None:
        # Rebalancing makes few files of a small batch and splits a hot bucket. Inside a
        # thread, mails lie by date, so the statistics of pages find the late ones.
        order = [c for c in ("bucket", "thread_id", "date", "email_id") if c in rows.columns]
        self._write(rows.hint("rebalance", "bucket").sortWithinPartitions(*order), name, writer, batch)

    def _commit(self, writer: str, batch: int, emails: int, mark: int | None, parsed: int | None = None) -> None:
        row = self.spark.range(1).select(
            *[F.lit(v).cast("bigint").alias(n) for n, v in (("emails", emails), ("mark", mark), ("parsed", parsed))])
        self._write(row.coalesce(1), "commits", writer, batch)

    def mark(self) -> int | None:
        """The newest ``internal_date`` that was stored, from where ``sources.mailapi``
        can go on; None for a store without mail of that kind."""
        return self._read("commits").agg(F.max("mark")).first()[0]

    def committed(self, writer: str, batch: int) -> bool:
        # One folder is looked at, however many batches there are.
        return any(name.startswith("part-") for name in entries(self.spark, f"{self.root}/commits/writer={writer}/batch={batch}"))

    def insert_new(
        self, parsed: DataFrame, batch: int = 0, ingest_time: Column | None = None, writer: str | None = None,
        extra: dict | None = None,
    ) -> None:
        """Stores the messages whose ids are new.

        Without a ``writer`` the call is a load of its own. Messages that cannot be
        read go to ``rejected``. ``extra`` adds attachment extractors by MIME type.
        The parsed messages are written down once, since several steps read them.
        """
        writer = writer or f"load-{uuid.uuid4().hex}"
        if self.committed(writer, batch):
            return
        with scratch_scope(self.spark):
            self._insert(parsed, batch, ingest_time, writer, extra)

    def insert_records(
        self, records: DataFrame, source: Source, batch: int = 0, ingest_time: Column | None = None, writer: str | None = None,
        extra: dict | None = None,
    ) -> None:
        """Stores the new messages of raw records, and parses no others.

        Ids and order come from the headers. First copies are chosen and known ids left
        out on these narrow rows; only what remains, and records whose id the headers
        leave in doubt, are parsed. If a chosen copy cannot be read, the other copies
        are parsed as well.
        """
        writer = writer or f"load-{uuid.uuid4().hex}"
        if self.committed(writer, batch):
            return
        with scratch_scope(self.spark):
            heads = stored(source.scan(records), "heads")
            named = heads.where("message_id IS NOT NULL")
            first = named.groupBy(F.col("message_id").alias("id")).agg(F.min("input_order").alias("input_order"))
            fresh = first.join(self.ids.known(first), "id", "left_anti")
            doubtful = heads.where("message_id IS NULL").select("input_order")
            chosen = stored(fresh.select("input_order").unionByName(doubtful), "chosen")
            read = stored(source.parse(self._chosen(records, source, heads, chosen)), "parsed")
            lost = read.where("error IS NOT NULL").select("input_order").join(fresh, "input_order").select("id")
            if not lost.isEmpty():
                others = named.join(lost, named.message_id == lost.id, "left_semi").join(chosen, "input_order", "left_anti")
                others = stored(others.select("input_order").distinct(), "others")
                more = source.parse(KeySet(others, "input_order", MailConfig.small_keys).inside(
                    records.withColumn("input_order", source.place())).drop("input_order"))
                read = read.unionByName(stored(more, "more"))
            self._store(read, heads, batch, ingest_time, writer, extra)

    def _chosen(self, records: DataFrame, source: Source, heads: DataFrame, chosen: DataFrame) -> DataFrame:
        """The chosen records, by a list of these or of the others, whichever is short."""
        number, total = chosen.count(), heads.count()
        if number == total:
            return records
        placed = records.withColumn("input_order", source.place())
        if number > MailConfig.small_keys and total - number <= MailConfig.small_keys:
            left_out = heads.select("input_order").join(chosen, "input_order", "left_anti")
            return KeySet(left_out, "input_order", MailConfig.small_keys).outside(placed).drop("input_order")
        return KeySet(chosen, "input_order", MailConfig.small_keys).inside(placed).drop("input_order")

    def _insert(self, parsed: DataFrame, batch: int, ingest_time: Column | None, writer: str, extra: dict | None) -> None:
        read = stored(parsed, "parsed")
        self._store(read, read, batch, ingest_time, writer, extra)

    def _store(
        self, read: DataFrame, heads: DataFrame, batch: int, ingest_time: Column | None, writer: str, extra: dict | None,
    ) -> None:
        """Writes a batch of parsed messages; ``heads`` are all records that were seen."""
        place = F.col("input_order").cast("string") if "input_order" in read.columns else F.lit(None).cast("string")
        self._write(read.where("error IS NOT NULL").select(place.alias("place"), "error"), "rejected", writer, batch)
        messages = usable_messages(read)
        if not messages.groupBy("message_id").count().where("count > 1").isEmpty():
            messages = stored(message_rows(read), "messages")
        known = stored(self.ids.known(messages.select(F.col("message_id").alias("id"))), "known")
        fresh = KeySet(known, "id", MailConfig.small_keys).outside(messages.withColumn("id", F.col("message_id"))).drop("id")
        fresh = fresh.withColumn("bucket", self._bucket(message_thread()))
        self._write_sorted(attachments_from(fresh, extra, keep=("bucket",)), "attachments", writer, batch)
        emails = emails_from(fresh, ingest_time)
        self._write_sorted(emails.withColumn("bucket", self._bucket(F.col("thread_id"))), "emails", writer, batch)
        own = read_table(self.spark, f"{self.root}/emails/writer={writer}/batch={batch}", EMAILS).select("id")
        self.ids.add(own, writer, batch)
        dated = "input_order" in heads.columns and "internal_date" in heads.schema["input_order"].dataType.names
        mark = heads.agg(F.max("input_order.internal_date")).first()[0] if dated else None
        self._commit(writer, batch, own.count(), mark, read.count())
        self.ids.fold()

    def compact(self, target: MailStore) -> None:
        """Writes the current state into an empty store as one batch of few files.

        Streams go on into the target with their checkpoints: their commits are
        taken along, so a batch they repeat is still known.
        """
        for name in ("emails", "attachments"):
            target._write_sorted(self._table(name).drop("writer", "batch"), name, "compacted", 0)
        target.ids.add(self.emails().select("id"), "compacted", 0)
        target._write(self.rejected(), "rejected", "compacted", 0)
        commits = self._read("commits").coalesce(1)
        commits.write.mode("overwrite").partitionBy("writer", "batch").parquet(f"{target.root}/commits")
        target._commit("compacted", 0, target._read("emails").count(), self.mark())
