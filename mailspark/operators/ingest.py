"""Parsed messages to the two stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.config import MailConfig
from mailspark.functions.dates import parse_mail_date
from mailspark.functions.files import attachment_text
from mailspark.functions.html import html_to_text
from mailspark.functions.mime import detect_mime
from mailspark.functions.text import choose_body, file_extension, split_references, thread_root
from mailspark.operators.skew import small_keys
from mailspark.session import small_batches


def first_per_key(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """The row with the smallest order per key.

    An aggregate, not a window: copies of a key fall together before the shuffle,
    so a key with any number of copies costs one row per map task.
    """
    rest = F.struct(*[c for c in df.columns if c not in keys])
    picked = df.groupBy(*keys).agg(F.min_by(rest, order).alias("_row"))
    return picked.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def last_per_key(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    rest = F.struct(*[c for c in df.columns if c not in keys])
    picked = df.groupBy(*keys).agg(F.max_by(rest, order).alias("_row"))
    return picked.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def usable_messages(parsed: DataFrame) -> DataFrame:
    """Parsed messages that could be read and have an id."""
    return parsed.where(F.col("error").isNull() & (F.coalesce("message_id", F.lit("")) != ""))


def message_rows(parsed: DataFrame) -> DataFrame:
    """Parsed messages with an id, one per id, the first in input order."""
    return first_per_key(usable_messages(parsed), ["message_id"], "input_order")


def absent(rows: DataFrame, stored: DataFrame, key: str = "id", small: int = MailConfig.small_keys) -> DataFrame:
    """Rows whose key is not stored yet.

    The keys of a small batch are broadcast to the stored table, which is then
    scanned for them without a shuffle; a large batch is joined.
    """
    stored = stored.select(key)
    batch, _ = small_keys(rows, key, small)
    if batch is not None:
        stored = stored.join(F.broadcast(batch), key, "left_semi")
    return rows.join(stored, key, "left_anti")


def message_thread() -> Column:
    """The thread of a parsed message."""
    own = thread_root(split_references(F.col("references_header")), F.col("in_reply_to"), F.col("message_id"))
    return F.coalesce("thread_key", own)


def emails_from(messages: DataFrame, ingest_time: Column | None = None) -> DataFrame:
    """``emails`` rows; a missing or unreadable date becomes the ingest time."""
    small_batches(messages.sparkSession)
    now = F.current_timestamp().cast("timestamp_ntz") if ingest_time is None else ingest_time
    html = html_to_text(F.when(F.col("html") != "", F.col("html")))
    return messages.select(
        F.col("message_id").alias("id"),
        message_thread().alias("thread_id"),
        "subject",
        split_references(F.col("references_header")).alias("references"),
        "in_reply_to",
        F.coalesce(parse_mail_date(F.col("date_header")), now).alias("date"),
        "sender",
        "recipients",
        choose_body(html, F.col("plain")).alias("body"),
        F.lit(False).alias("is_embedded"),
    )


def attachment_id(email_id: Column, filename: Column) -> Column:
    """Derived from what identifies the file, so a retry writes the same row."""
    return F.sha2(F.concat_ws("/", email_id, filename), 256)


def dedup_attachments(files: DataFrame) -> DataFrame:
    """One file per name within an email: the last part wins."""
    return last_per_key(files, ["email_id", "filename"], "part_no")


def attachments_from(messages: DataFrame, extra=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``attachments`` rows of messages, with the ``keep`` columns of these."""
    small_batches(messages.sparkSession)
    files = messages.select(F.col("message_id").alias("email_id"), *keep, F.inline("files"))
    files = dedup_attachments(files)
    typed = files.withColumn("mime_type", detect_mime(F.col("content"), F.col("declared_type"), F.col("filename")))
    return typed.select(
        attachment_id(F.col("email_id"), F.col("filename")).alias("id"),
        "email_id", "filename", "mime_type",
        file_extension(F.col("filename")).alias("extension"),
        F.length("content").cast("int").alias("size"),
        attachment_text(F.col("mime_type"), F.col("content"), extra).alias("text_content"),
        *keep,
    )
