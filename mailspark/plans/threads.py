"""From stored emails to collection rows, for all pending threads in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailspark.config import MailConfig
from mailspark.operators.chunking import chunk_text
from mailspark.operators.embedding import Embedder, hashed_terms
from mailspark.operators.packing import chunk_segments
from mailspark.operators.skew import KeySet, small_side
from mailspark.operators.summarize import Summarizer, summarize_documents
from mailspark.operators.threads import LAYOUT, document_parts, rebuild_scope, thread_metadata
from mailspark.schemas import METADATA
from mailspark.session import stored
from mailspark.sources.models import chunk_chars, model


@dataclass(frozen=True)
class ThreadRun:
    """What one run produces; nothing is stored yet."""

    chunks: DataFrame      # collection rows
    threads: DataFrame     # (thread_id, segment, text, summary, metadata)
    changed: DataFrame     # (thread_id): all rebuilt threads, empty ones too
    embedded: DataFrame    # (thread_id, id): all emails that were read


def document_chunks(
    emails: DataFrame, attachments: DataFrame | None, cfg: MailConfig,
) -> tuple[DataFrame, DataFrame | None]:
    """Documents as ``(thread_id, segment, text, chunk_count, chunks, meta, whole)``,
    and the chunks ``(thread_id, chunk_no, text)`` of those in segments.

    The count is of the whole thread; ``whole`` says that the row is the whole
    document. ``chunks`` are those of a whole document that stays as it is; they are
    found once. Chunks do not depend on whether a document is in segments.
    """
    size = chunk_chars(cfg)
    light, large = document_parts(emails, attachments, cfg)
    light = light.withColumn("chunks", chunk_text(F.col("text"), size, cfg.separators))
    count = F.size("chunks").cast("bigint")
    kept = F.when(count <= cfg.max_chunks, F.col("chunks"))
    light = light.select("thread_id", "segment", "text", count.alias("chunk_count"), kept.alias("chunks"), "meta", F.lit(True).alias("whole"))
    if large is None:
        return light, None
    large = stored(large, "segments")
    pieces = stored(chunk_segments(large, size, cfg.separators, LAYOUT), "chunks")
    ids = KeySet(large.select("thread_id").distinct(), "thread_id", cfg.small_keys)
    meta = thread_metadata(ids.inside(emails), attachments)
    meta = meta.select("thread_id", F.struct(*light.schema["meta"].dataType.names).alias("meta"))
    counts = pieces.groupBy(F.col("thread_id").alias("_thread")).agg(F.count("*").alias("chunk_count"))
    facts = small_side(meta.join(counts, F.col("thread_id").eqNullSafe(F.col("_thread"))).drop("thread_id"), cfg.small_keys)
    joined = large.join(facts, F.col("thread_id").eqNullSafe(F.col("_thread"))).select(
        "thread_id", "segment", "text", "chunk_count", F.lit(None).cast("array<string>").alias("chunks"), "meta", F.lit(False).alias("whole"))
    return light.unionByName(joined), pieces


def chunked_documents(emails: DataFrame, attachments: DataFrame | None, cfg: MailConfig) -> DataFrame:
    return document_chunks(emails, attachments, cfg)[0]


def _metadata(length, summarized):
    return F.struct(
        F.lit("email").alias("type"), F.col("thread_id"),
        *[F.col(f"meta.{name}").alias(name) for name in METADATA.names[2:8]],
        length.alias("text_block_len"), F.col("chunk_count").alias("chunk_size_original"),
        summarized.alias("is_summarized"),
    ).alias("metadata")


def _finals(documents: DataFrame, summaries: DataFrame, cfg: MailConfig) -> DataFrame:
    """Whole documents with ``summary``, ``final`` and ``metadata``: one row per
    thread, and only summarized ones are joined."""
    over = F.col("chunk_count") > cfg.max_chunks
    plain = documents.where(~over).withColumn("summary", F.lit(None).cast("string"))
    texts = plain.unionByName(_with_summary(documents.where(over), summaries))
    texts = texts.withColumn("final", F.coalesce(F.nullif("summary", F.lit("")), "text"))
    length = F.length("final").cast("bigint")
    return texts.select("thread_id", "segment", "text", "summary", "final", "chunks", _metadata(length, over))


def _with_summary(documents: DataFrame, summaries: DataFrame) -> DataFrame:
    named = summaries.select(F.col("thread_id").alias("_thread"), "summary")
    return documents.join(named, F.col("thread_id").eqNullSafe(F.col("_thread")), "left").drop("_thread")


def _segmented_finals(documents: DataFrame, summaries: DataFrame, cfg: MailConfig) -> DataFrame:
    """Per thread in segments its ``summary``, ``last`` segment and ``metadata``."""
    over = F.col("chunk_count") > cfg.max_chunks
    facts = documents.groupBy("thread_id").agg(
        F.max("meta").alias("meta"), F.max("chunk_count").alias("chunk_count"),
        F.sum(F.length("text")).cast("bigint").alias("total"), F.max("segment").alias("last"))
    joined = _with_summary(facts, summaries)
    length = F.when(F.coalesce("summary", F.lit("")) != "", F.length("summary")).otherwise(F.col("total")).cast("bigint")
    return joined.select("thread_id", "summary", "last", _metadata(length, over))


def build_threads(
    emails: DataFrame, attachments: DataFrame | None = None, cfg: MailConfig = MailConfig(),
    embedder: Embedder | None = None, summarizer: Summarizer | None = None, pending: DataFrame | None = None,
) -> ThreadRun:
    """Rebuilds every pending thread: document, chunks, summary if there are too
    many, embedding, metadata. Pending are the given threads, else those with an
    email that is marked as not embedded.

    Documents are stored once, because several steps read them and their assembly
    holds the wide shuffle and the diff.
    """
    embedder = embedder or hashed_terms(model(cfg.embed_model)[2])
    size = chunk_chars(cfg)
    scope = rebuild_scope(emails, cfg, pending)
    documents, large_chunks = document_chunks(scope, attachments, cfg)
    documents = stored(documents, "documents")
    gated = documents.where(F.col("chunk_count") > cfg.max_chunks)
    summaries = summarize_documents(gated.select("thread_id", "segment", "text"), cfg, summarizer)
    # What no summarizer shortened can be in segments; it is joined as it was cut.
    listed = F.array_sort(F.collect_list(F.struct("segment", "summary")))
    summaries = summaries.groupBy("thread_id").agg(
        F.array_join(F.transform(listed, lambda p: p["summary"]), "\n\n").alias("summary"))

    threads = _finals(documents.where("whole"), summaries, cfg)
    # Chunks of documents that stay as they are were found with the documents.
    pieces = threads.select("thread_id", "metadata", F.posexplode_outer(
        F.coalesce("chunks", chunk_text(F.col("final"), size, cfg.separators))).alias("chunk_no", "text"))
    threads = threads.select("thread_id", "segment", "text", "summary", "metadata")
    if large_chunks is not None:
        of_large = documents.where(~F.col("whole"))
        facts = small_side(stored(_segmented_finals(of_large, summaries, cfg), "facts").withColumnRenamed("thread_id", "_thread"), cfg.small_keys)
        same = F.col("thread_id").eqNullSafe(F.col("_thread"))
        summarized = F.coalesce("summary", F.lit("")) != ""
        short = facts.where(summarized).select(F.col("_thread").alias("thread_id"), "metadata", F.posexplode_outer(
            chunk_text(F.col("summary"), size, cfg.separators)).alias("chunk_no", "text"))
        long_ = large_chunks.join(facts.where(~summarized), same).select("thread_id", "metadata", "chunk_no", "text")
        pieces = pieces.unionByName(short).unionByName(long_)
        # One entry of a dump: it begins with the metadata and ends with the summary.
        first = of_large.groupBy(F.col("thread_id").alias("_first")).agg(F.min("segment").alias("from"))
        facts = small_side(facts.join(first, F.col("_thread").eqNullSafe(F.col("_first"))).drop("_first"), cfg.small_keys)
        parts = of_large.join(facts, same)
        threads = threads.unionByName(parts.select(
            "thread_id", "segment", "text", F.when(F.col("segment") == F.col("last"), F.col("summary")).alias("summary"),
            F.when(F.col("segment") == F.col("from"), F.col("metadata")).alias("metadata")))

    chunks = pieces.where(F.col("text").isNotNull()).select(
        "thread_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "text",
        embedder(F.col("text")).alias("embedding"), "metadata",
    )
    return ThreadRun(
        chunks=chunks,
        threads=threads,
        changed=scope.select("thread_id").distinct(),
        embedded=scope.select("thread_id", "id"),
    )
