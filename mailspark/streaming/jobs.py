"""The two endless loops as Structured Streaming queries.

Both keep their state in tables, not in operators, so a reply may arrive at any
age and still rebuilds its thread; and both write per ``batchId``. The ingest
stream writes as the query its checkpoint belongs to, so a batch that is run again
is known, and a stream with a new checkpoint is another writer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailspark.config import MailConfig
from mailspark.operators.collection import Collection
from mailspark.operators.dump import write_dump
from mailspark.operators.embedding import Embedder
from mailspark.operators.summarize import Summarizer
from mailspark.plans.ingest import MailStore
from mailspark.plans.threads import build_threads
from mailspark.session import scratch_scope
from mailspark.sources.headers import Source

POLL_INTERVAL = "20 seconds"
EMBED_INTERVAL = "10 seconds"


def _start(stream: DataFrame, body, checkpoint: str, once: bool, interval: str) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def ingest_stream(
    records: DataFrame, parse: Source | Callable[[DataFrame], DataFrame], store: MailStore, checkpoint: str,
    once: bool = False, interval: str = POLL_INTERVAL, extra: dict | None = None,
) -> StreamingQuery:
    """Stores new messages from arriving files; known ids are skipped for good,
    not just within a watermark. With a ``Source`` only new messages are parsed."""
    def body(batch: DataFrame, batch_id: int) -> None:
        # The id of the query lives in its checkpoint.
        writer = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if isinstance(parse, Source):
            store.insert_records(batch, parse, batch_id, writer=writer, extra=extra)
        else:
            store.insert_new(parse(batch), batch_id, writer=writer, extra=extra)

    return _start(records, body, checkpoint, once, interval)


def embed_pending(
    store: MailStore, collection: Collection, batch: int, cfg: MailConfig = MailConfig(),
    embedder: Embedder | None = None, summarizer: Summarizer | None = None, dump: str | None = None,
    touched: DataFrame | None = None,
) -> None:
    """Rebuilds the touched threads and those whose last attempt failed; without
    ``touched``, all threads with an email the ledger does not know.

    Which threads are pending is found on ids alone; texts are read only for them.
    """
    with scratch_scope(collection.spark):
        if touched is None:
            waiting = store.emails().where(~F.col("is_embedded")).select("id", "thread_id")
            pending = waiting.join(collection.embedded().select("id"), "id", "left_anti").select("thread_id")
        else:
            pending = touched.select("thread_id").unionByName(collection.failed_threads())
        pending = pending.distinct()
        emails, attachments = store.near_threads(pending, cfg.small_keys)
        run = build_threads(emails, attachments, cfg, embedder, summarizer, pending)
        collection.write_batch(batch, run.chunks, run.changed, run.embedded)
        if dump:
            # A thread whose embedding failed is not done, so it is not dumped.
            failed = collection.failed_in(batch)
            done = run.threads.join(failed, F.col("thread_id").eqNullSafe(failed["_failed"]), "left_anti")
            write_dump(done, f"{dump}/batch={batch}")


def embed_stream(
    store: MailStore, collection: Collection, checkpoint: str,
    cfg: MailConfig = MailConfig(), once: bool = False, interval: str = EMBED_INTERVAL,
    embedder: Embedder | None = None, summarizer: Summarizer | None = None, dump: str | None = None,
) -> StreamingQuery:
    """Rebuilds the threads of the emails that were committed to the store.

    A batch that fails is run again by the stream; a thread that fails inside a
    batch is taken along by the next one.
    """
    def body(batch: DataFrame, batch_id: int) -> None:
        embed_pending(store, collection, batch_id, cfg, embedder, summarizer, dump, store.threads_of(batch))

    return _start(store.arrivals(), body, checkpoint, once, interval)


def live_metadata(emails: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """Running counts and dates per thread, for a stream in update or complete mode.

    ``attachments`` are rows with ``id`` and ``thread_id``; they count as they arrive,
    be it before or after their email. A mail or a file that arrives again counts
    once, in whichever batch: its first arrival is kept by id. That state is one key
    per mail and file, spread by id, so a hot thread is no hot key in it.
    """
    mails = emails.select("thread_id", "date", "id", "subject", "sender", F.lit(None).cast("string").alias("file"))
    if attachments is not None:
        none = [F.lit(None).cast(emails.schema[n].dataType).alias(n) for n in ("date", "id", "subject", "sender")]
        mails = mails.unionByName(attachments.select("thread_id", *none, F.col("id").cast("string").alias("file")))
    arrived = mails.dropDuplicates(["id", "file"])
    root = F.min_by(F.struct("subject", "sender"), F.when(F.col("id").isNotNull(), F.struct("date", "id")))
    return arrived.groupBy("thread_id").agg(
        root.alias("root"), F.count("id").alias("email_count"), F.count("file").alias("attachments_count"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    ).select("thread_id", "root.*", "email_count", "attachments_count", "first_date", "last_date")
