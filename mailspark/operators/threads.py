"""Threads: position, document and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailspark.config import MailConfig
from mailspark.functions.text import datetime_text, remove_links, strip
from mailspark.operators.packing import Layout
from mailspark.operators.quotes import diff_verdicts, quote_split, quoted_part, settled, strip_quotes
from mailspark.operators.skew import KeySet, heavy_keys, sums_by_range, sums_in_task
from mailspark.session import stored

# The marks of the document layout.
BEGIN_THREAD = "===== Begin Email Thread ====="
END_THREAD = "===== End Email Thread ====="
END_EMAIL = "\n--- End Email ---"
END_ATTACHMENT = "\n--- End Attachment ---"
TAIL = f"\n\n{END_THREAD}"
# How the segments of a large document join: at the ends of emails.
LAYOUT = Layout(END_EMAIL.strip(), BEGIN_THREAD, TAIL, END_THREAD)
NO_SUBJECT = "(no subject)"
# About what the marks around a piece add to its length.
_MARKS = 64


def pending_threads(emails: DataFrame) -> DataFrame:
    """Threads with at least one email that is known not to be embedded."""
    return emails.where(~F.col("is_embedded")).select("thread_id").distinct()


def rebuild_scope(emails: DataFrame, cfg: MailConfig = MailConfig(), pending: DataFrame | None = None) -> DataFrame:
    """All emails of the pending threads.

    Few threads are broadcast to the scan. In a first load nothing is embedded
    yet, and the emails are taken as they are instead of joined.
    """
    if pending is None:
        if emails.where(F.coalesce("is_embedded", F.lit(True))).isEmpty():
            return emails
        pending = pending_threads(emails)
    return KeySet(pending, "thread_id", cfg.small_keys).inside(emails)


def email_positions(emails: DataFrame, cfg: MailConfig = MailConfig()) -> DataFrame:
    """Adds ``position``, 1-based by date inside the thread."""
    order, count = ["date", "id"], {"position": F.lit(1).cast("bigint")}
    heavy = heavy_keys(emails, "thread_id", F.lit(1), cfg.heavy_rows, cfg.small_keys)
    light = sums_in_task(heavy.outside(emails), "thread_id", order, count)
    if heavy.empty:
        return light
    # Large threads are ranked on their keys alone and meet their texts by id.
    large = heavy.inside(emails)
    ranks = sums_by_range(large.select("thread_id", *order), "thread_id", order, count).select("id", "position")
    return light.unionByName(large.join(ranks, "id"))


def email_attachments(emails: DataFrame, attachments: DataFrame) -> DataFrame:
    """Emails with the number and the size of their attachments."""
    sums = attachments.groupBy(F.col("email_id").alias("id")).agg(
        F.count("*").alias("attachments_count"), F.sum("size").alias("attachments_size"),
    )
    joined = emails.join(sums, "id", "left")
    return joined.fillna(0, ["attachments_count", "attachments_size"])


def email_head(number: Column, date: Column, text: Column) -> Column:
    return F.concat(
        F.lit("--- Email "), number.cast("string"), F.lit(" ---\nDate: "),
        F.coalesce(datetime_text(date), F.lit("None")), F.lit("\n\n"), text,
    )


def attachment_block(filename: Column, extension: Column, text: Column) -> Column:
    return F.concat(
        F.lit("\n\n--- Begin Attachment: "), filename, F.lit(" ("), F.coalesce(extension, F.lit("None")),
        F.lit(") ---\n"), strip(text), F.lit(END_ATTACHMENT),
    )


def document_head(subject: Column) -> Column:
    shown = F.when(F.coalesce(subject, F.lit("")) == "", NO_SUBJECT).otherwise(strip(subject))
    return F.concat(F.lit(f"{BEGIN_THREAD}\n\nSubject: "), shown)


def _weight(text: str) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("bigint") + _MARKS


def has_text() -> Column:
    return F.coalesce(F.col("text_content"), F.lit("")) != ""


def _owned(attachments: DataFrame, emails: DataFrame) -> DataFrame:
    owners = emails.select(F.col("id").alias("email_id"), "thread_id", "date")
    # Weighed before the join, so that weights alone do not take the texts along.
    return attachments.withColumn("_weight", _weight("text_content")).join(owners, "email_id")


def _whole_documents(emails: DataFrame, files: DataFrame | None, cfg: MailConfig) -> DataFrame:
    """One document per thread, for threads that fit into a task.

    Bodies cross the network once: emails and attachments meet on a hash of the
    thread id, and everything after it (attachments to email, reply to parent,
    order, concatenation, counts) stays inside that partitioning.
    """
    mail = F.struct("date", "id", "in_reply_to", "subject", "sender", "body").alias("mail")
    if files is None:
        rows = emails.select("thread_id", mail, F.array().cast("array<string>").alias("blocks")).repartition("thread_id")
    else:
        block = F.when(has_text(), attachment_block(F.col("filename"), F.col("extension"), F.col("text_content")))
        block = F.struct("filename", "id", block.alias("block"))
        parts = emails.select("thread_id", F.col("id").alias("email_id"), mail).unionByName(
            files.select("thread_id", "email_id", block.alias("file")), allowMissingColumns=True,
        )
        rows = (
            parts.repartition("thread_id").groupBy("thread_id", "email_id")
            .agg(F.first("mail", ignorenulls=True).alias("mail"), F.array_sort(F.collect_list("file")).alias("files"))
            .select("thread_id", "mail", F.transform("files", lambda f: f["block"]).alias("blocks"))
        )

    # Each email is there as a possible parent under its id and as a reply under
    # the id it answers, so the parent is the first row of a group.
    roles = rows.select("thread_id", F.explode(F.array(
        F.struct(F.col("mail.id").alias("key"), F.lit(0).alias("role"), strip(F.col("mail.body")).alias("parent"),
                 F.lit(None).cast(rows.schema["mail"].dataType).alias("mail"),
                 F.lit(None).cast("array<string>").alias("blocks")),
        F.struct(F.col("mail.in_reply_to").alias("key"), F.lit(1).alias("role"), F.lit(None).cast("string").alias("parent"),
                 F.col("mail"), F.col("blocks")),
    )).alias("r")).select("thread_id", "r.*")
    group = Window.partitionBy("thread_id", "key").orderBy("role").rowsBetween(Window.unboundedPreceding, 0)
    replies = roles.withColumn("parent", F.first("parent").over(group)).where("role = 1")

    replies = replies.withColumn("quote", F.when(F.col("parent").isNotNull(), quote_split(F.col("mail.body"))))
    replies = replies.withColumn("tail", quoted_part(F.col("quote"), cfg))
    replies = replies.withColumn("same", settled(F.col("tail"), F.col("parent"), cfg))
    open_case = F.col("tail").isNotNull() & F.col("same").isNull()
    mails = replies.select("thread_id", F.struct(
        "mail.date", "mail.id", "mail.subject", "mail.sender", strip(F.col("mail.body")).alias("text"),
        F.when(open_case | F.col("same"), strip(F.col("quote")[0])).alias("own_text"), "same",
        F.when(open_case, F.col("tail")).alias("tail"), F.when(open_case, F.col("parent")).alias("parent"),
        "blocks",
    ).alias("mail"))
    threads = mails.groupBy("thread_id").agg(F.array_sort(F.collect_list("mail")).alias("mails"))

    # The diff comes last: a Python step does not keep the partitioning.
    verdicts = diff_verdicts(
        F.transform("mails", lambda m: m["tail"]), F.transform("mails", lambda m: m["parent"]), cfg,
    )
    threads = threads.withColumn("verdicts", verdicts)

    def shown(item: Column, index: Column) -> Column:
        quoted = (index > 0) & F.coalesce(item["same"], F.get(F.col("verdicts"), index), F.lit(False))
        return F.when(quoted, item["own_text"]).otherwise(item["text"])

    texts = F.transform("mails", shown)
    threads = threads.select("thread_id", "mails", texts.alias("texts")).where(F.exists("texts", lambda t: t != ""))

    def email_part(item: Column, index: Column) -> Column:
        text = F.get(F.col("texts"), index)
        part = F.concat(
            email_head(index + 1, item["date"], text), F.array_join(item["blocks"], ""), F.lit(END_EMAIL),
        )
        return F.when(text != "", part)

    # array_join leaves out the NULL parts of empty emails.
    text = F.concat(
        document_head(F.col("mails")[0]["subject"]), F.lit("\n\n"),
        F.array_join(F.transform("mails", email_part), "\n\n"), F.lit(TAIL),
    )
    mails = F.col("mails")
    meta = F.struct(
        mails[0]["subject"].alias("subject"), mails[0]["sender"].alias("sender"),
        F.size(mails).cast("bigint").alias("email_count"),
        F.aggregate(mails, F.lit(0).cast("bigint"), lambda n, m: n + F.size(m["blocks"])).alias("attachments_count"),
        datetime_text(F.array_min(F.transform(mails, lambda m: m["date"]))).alias("first_email_date"),
        datetime_text(F.array_max(F.transform(mails, lambda m: m["date"]))).alias("last_email_date"),
    )
    return threads.select(
        "thread_id", F.lit(0).cast("bigint").alias("segment"), remove_links(text).alias("text"), meta.alias("meta"),
    )


def _segmented_documents(emails: DataFrame, files: DataFrame, cfg: MailConfig) -> DataFrame:
    """Documents of threads too large for one task, as ordered segments.

    The concatenation of a thread's segments is its document; a segment ends with
    an email. A thread is ranked by range over narrow rows, one per email, and texts
    join in by message id. Head and end of the document are pieces like others.
    """
    one = F.lit(1).cast("bigint")
    attached = files.groupBy("email_id").agg(F.sum("_weight").alias("attached"))
    keys = emails.select("thread_id", "date", F.col("id").alias("email_id"), _weight("body").alias("own"))
    keys = keys.join(attached, "email_id", "left").select(
        "thread_id", "date", "email_id", (F.col("own") + F.coalesce("attached", F.lit(0))).alias("weight"))
    keys = sums_by_range(keys, "thread_id", ["date", "email_id"], {"n": one, "chars": F.col("weight")})
    keys = keys.withColumn("segment", F.floor((F.col("chars") - F.col("weight")) / cfg.heavy_chars).cast("bigint"))

    # Stored, since three steps read it and the diff should run once.
    own = stored(strip_quotes(emails, cfg).where(F.col("text") != "").select(F.col("id").alias("email_id"), "text"), "own")
    written = own.select("email_id")
    none = F.lit("").alias("filename"), F.lit("").alias("file_id")
    blocks = files.join(written, "email_id").select(
        "email_id", F.lit(1).alias("kind"), "filename", F.col("id").alias("file_id"),
        attachment_block(F.col("filename"), F.col("extension"), F.col("text_content")).alias("text"))
    texts = own.select("email_id", F.lit(0).alias("kind"), *none, "text").unionByName(blocks).unionByName(
        written.select("email_id", F.lit(2).alias("kind"), *none, F.lit(END_EMAIL).alias("text")))
    head = F.concat(F.lit("\n\n"), email_head(F.col("n"), F.col("date"), F.col("text")))
    order = ["part", "date", "email_id", "kind", "filename", "file_id"]
    pieces = texts.join(keys, "email_id").select(
        "thread_id", "segment", F.lit(1).alias("part"), *order[1:], F.when(F.col("kind") == 0, head).otherwise(F.col("text")).alias("piece"))

    subjects = emails.groupBy("thread_id").agg(F.min(F.struct("date", "id", "subject")).alias("root"))
    subjects = subjects.select(F.col("thread_id").alias("_thread"), document_head(F.col("root.subject")).alias("head"))
    ends = keys.join(written, "email_id", "left_semi").groupBy("thread_id").agg(F.min("segment").alias("first"), F.max("segment").alias("last"))
    ends = ends.join(subjects, F.col("thread_id").eqNullSafe(F.col("_thread")))
    marks = ends.select("thread_id", F.inline(F.array(
        F.struct(F.col("first").alias("segment"), F.lit(0).alias("part"), F.col("head").alias("piece")),
        F.struct(F.col("last").alias("segment"), F.lit(2).alias("part"), F.lit(TAIL).alias("piece")))))
    pieces = pieces.unionByName(marks, allowMissingColumns=True)
    listed = F.array_sort(F.collect_list(F.struct(*order, "piece")))
    segments = pieces.groupBy("thread_id", "segment").agg(listed.alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    return segments.select("thread_id", "segment", remove_links(text).alias("text"))


def heavy_threads(emails: DataFrame, attachments: DataFrame | None, cfg: MailConfig) -> KeySet:
    """Threads whose texts together exceed ``heavy_chars`` or ``heavy_rows``."""
    rows = emails.select("thread_id", _weight("body").alias("chars"))
    if attachments is not None:
        sizes = attachments.select("email_id", _weight("text_content").alias("chars"))
        owners = emails.select(F.col("id").alias("email_id"), "thread_id")
        rows = rows.unionByName(sizes.join(owners, "email_id").select("thread_id", "chars"))
    sums = rows.groupBy("thread_id").agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))
    heavy = sums.where((F.col("chars") > cfg.heavy_chars) | (F.col("n") > cfg.heavy_rows))
    return KeySet(heavy, "thread_id", cfg.small_keys)


def document_parts(
    emails: DataFrame, attachments: DataFrame | None = None, cfg: MailConfig = MailConfig(),
) -> tuple[DataFrame, DataFrame | None]:
    """Documents of threads that fit a task, with their metadata, and the
    segments of those that do not (None when there are none)."""
    files = None if attachments is None else _owned(attachments, emails)
    heavy = heavy_threads(emails, attachments, cfg)
    light = _whole_documents(heavy.outside(emails), None if files is None else heavy.outside(files), cfg)
    if heavy.empty:
        return light, None
    large = heavy.inside(emails)
    if files is None:
        none = large.limit(0).select("thread_id", "date", F.col("id").alias("email_id"), "id")
        none = none.withColumn("_weight", F.lit(0).cast("bigint"))
        large_files = none.select("*", *[F.lit("").alias(c) for c in ("filename", "extension", "text_content")])
    else:
        large_files = heavy.inside(files.where(has_text()))
    return light, _segmented_documents(large, large_files, cfg)


def thread_documents(
    emails: DataFrame, attachments: DataFrame | None = None, cfg: MailConfig = MailConfig(),
) -> DataFrame:
    """``(thread_id, segment, text)``: the cleaned document of every thread.

    Threads have one row (segment 0) unless they outgrow a task; then the
    document is the concatenation of the segments.
    """
    light, large = document_parts(emails, attachments, cfg)
    light = light.select("thread_id", "segment", "text")
    return light if large is None else light.unionByName(large)


def thread_metadata(emails: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """Counts, dates and the root's subject and sender of every thread."""
    if attachments is None:
        counted = emails.withColumn("attachments_count", F.lit(0).cast("bigint"))
    else:
        counted = email_attachments(emails, attachments)
    root = F.min(F.struct("date", "id", "subject", "sender"))
    return counted.groupBy("thread_id").agg(
        root.alias("root"), F.count("*").alias("email_count"), F.sum("attachments_count").alias("attachments_count"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    ).select(
        "thread_id", "root.subject", "root.sender", "email_count", "attachments_count",
        datetime_text(F.col("first_date")).alias("first_email_date"),
        datetime_text(F.col("last_date")).alias("last_email_date"),
    )


def latest_email(emails: DataFrame) -> DataFrame:
    """The newest email; ties go to the larger id."""
    return emails.orderBy(F.desc("date"), F.desc("id")).limit(1)
