"""The registered queries: every operator over whole driver tables.

Operators that read mail formats get messages that Spark renders from the tables
first, so their work grows with the tables and their result is known.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.config import MailConfig
from mailspark.functions import dates, files, html, mime, text
from mailspark.operators import chunking, collection, dump, embedding, frequencies, ingest, quotes, search, stats, summarize, threads
from mailspark.operators.collection import mark_embedded
from mailspark.operators.vector_index import VectorIndex
from mailspark.plans.ingest import MailStore
from mailspark.plans.resume import ThreadChunks
from mailspark.plans.threads import build_threads, chunked_documents
from mailspark.schemas import COLLECTION
from mailspark.session import scratch_path, small_batches, stored
from mailspark.sources import fixtures, mailapi, mbox, models
from mailspark.sources.fixtures import table

CFG = MailConfig()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def on_emails(function: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark, sf):
        return function(fixtures.emails(spark, sf))

    QUERIES[function.__name__] = run
    return run


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return threads.thread_documents(fixtures.emails(spark, sf), fixtures.attachments(spark, sf), CFG)


# --- threads -----------------------------------------------------------------

@on_emails
def email_position(emails):
    return threads.email_positions(emails.select("id", "thread_id", "date"), CFG).drop("date")


@on_emails
def pending_threads(emails):
    return threads.pending_threads(emails)


@on_emails
def thread_emails(emails):
    scope = threads.rebuild_scope(emails, CFG)
    return threads.email_positions(scope, CFG).select("id", "thread_id", "position", "body")


@on_emails
def rebuild_scope(emails):
    return threads.rebuild_scope(emails, CFG).select("id", "thread_id", "is_embedded")


@query
def email_attachments(spark, sf):
    joined = threads.email_attachments(fixtures.emails(spark, sf), fixtures.attachments(spark, sf))
    return joined.select("id", "attachments_count", "attachments_size")


@on_emails
def reply_parent(emails):
    parents = quotes.reply_parents(emails)
    return parents.select("id", "parent_id", F.length("parent_body").cast("bigint").alias("parent_chars"))


@on_emails
def quote_split(emails):
    split = emails.select("id", quotes.quote_split(F.col("body")).alias("q"))
    return split.select("id", F.col("q")[0].alias("head"), F.col("q")[1].alias("tail"))


@on_emails
def quote_strip(emails):
    return quotes.strip_quotes(emails, CFG).select("id", "text")


@query
def quote_diff(spark, sf):
    """Two halves of a text in either order, with marks that match nothing: the longer
    half is all that matches, so the ratio is known, while every character occurs in
    both and only the diff can tell."""
    share = 55 + F.col("doc_id") % 9 * 5
    # Rounded up, so the first half is never the shorter one.
    cut = F.floor((F.length("text") * share + 99) / 100).cast("int")
    first, rest = F.substring(F.col("text"), F.lit(1), cut), F.substring(F.col("text"), cut + 1, F.length("text"))
    framed = lambda a, b, marks: F.concat(F.lit(marks[0]), a, F.lit(marks[1]), b, F.lit(marks[2]))
    # The diff costs far more than the scan: texts are dealt to all tasks, however few
    # row groups hold them.
    docs = table(spark, sf, "documents").select("doc_id", "text").repartition(F.xxhash64("doc_id", "text"))
    pairs = docs.select(
        "doc_id", framed(first, rest, "\x01\x02\x03").alias("original"), framed(rest, first, "\x04\x05\x06").alias("quoted"))
    cfg = MailConfig(autojunk=False)
    verdict = quotes.diff_verdicts(F.array("quoted"), F.array("original"), cfg)[0]
    return pairs.select("doc_id", F.coalesce(quotes.settled(F.col("quoted"), F.col("original"), cfg), verdict).alias("similar"))


@query
def thread_document(spark, sf):
    return documents(spark, sf)


SEGMENTED = MailConfig(heavy_chars=2000)


@query
def thread_document_segmented(spark, sf):
    rows = threads.thread_documents(fixtures.emails(spark, sf), fixtures.attachments(spark, sf), SEGMENTED)
    parts = F.array_sort(F.collect_list(F.struct("segment", "text")))
    joined = F.array_join(F.transform(parts, lambda p: p["text"]), "")
    return rows.groupBy("thread_id").agg(joined.alias("text"))


@query
def thread_metadata(spark, sf):
    return threads.thread_metadata(fixtures.emails(spark, sf), fixtures.attachments(spark, sf))


@on_emails
def latest_email(emails):
    return threads.latest_email(emails).select("id", "date", "sender")


# --- ingest ------------------------------------------------------------------

@on_emails
def first_wins_dedup(emails):
    first = emails.select("id", "subject", "body", F.lit(0).alias("source"))
    second = emails.select("id", F.concat(F.lit("copy "), "subject").alias("subject"), "body", F.lit(1).alias("source"))
    rows = first.unionByName(second).withColumn("input_order", (F.length("body") + F.col("source")) % 2).drop("body")
    return ingest.first_per_key(rows, ["id"], "input_order").drop("input_order")


@on_emails
def emails_insert_new(emails):
    return ingest.absent(emails, emails.where("is_embedded")).select("id", "thread_id", "subject")


@query
def attachments_insert(spark, sf):
    emails = fixtures.emails(spark, sf)
    new = ingest.absent(emails, emails.where("is_embedded")).select(F.col("id").alias("email_id"))
    found = fixtures.attachments(spark, sf).join(new, "email_id")
    return found.select(
        ingest.attachment_id(F.col("email_id"), F.col("filename")).alias("id"), "email_id", "filename", "size",
    )


@query
def attachments_dedup(spark, sf):
    parts = table(spark, sf, "documents").select(
        F.concat(F.lit("m"), (F.col("doc_id") % 40).cast("string")).alias("email_id"),
        F.concat("lang", F.lit(".txt")).alias("filename"), F.col("doc_id").alias("part_no"), F.col("n_chars").alias("size"),
    )
    return ingest.dedup_attachments(parts)


@query
def mark_embedded_emails(spark, sf):
    emails = fixtures.emails(spark, sf)
    return mark_embedded(emails, emails.where(F.length("body") % 2 == 0)).select("id", "is_embedded")


QUERIES["mark_embedded"] = QUERIES.pop("mark_embedded_emails")


@on_emails
def references_split(emails):
    header = F.array_join("references", " \t\n ")
    refs = text.split_references(header)
    return emails.select("id", F.size(refs).alias("n"), F.array_join(refs, "|").alias("refs"))


@on_emails
def thread_root(emails):
    root = text.thread_root(F.col("references"), F.col("in_reply_to"), F.col("id"))
    return emails.select("id", root.alias("root"))


@query
def recipients(spark, sf):
    header = F.concat(
        F.lit('"A user" <'), "role", F.col("conv_id").cast("string"), F.lit("@example.com>, list-"),
        F.col("turn").cast("string"), F.lit("@lists.example.org"),
    )
    found = F.array_join(text.plain_addresses(header), "|")
    return table(spark, sf, "conversations").select("conv_id", "turn", found.alias("recipients"))


@on_emails
def body_select(emails):
    even = (F.length("body") % 2 == 0) & (F.col("body") != "")
    page = F.when(even, F.col("body")).otherwise("")
    plain = F.when(even, F.lit("unused")).otherwise(F.concat(F.lit(" \0\n"), "body"))
    return emails.select("id", text.choose_body(page, plain).alias("body"))


@query
def text_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.normalize_text(F.col("html")).alias("text"))


@on_emails
def remove_links(emails):
    return emails.select("id", text.remove_links(F.col("body")).alias("text"))


@query
def file_extension(spark, sf):
    number = F.col("doc_id").cast("string")
    patterns = [("report", ".PDF"), ("a", ".tar.GZ"), (".profile", ""), ("dir.d/name", ""), ("x", "."), ("..y", ".Txt")]
    name = F.lit(None).cast("string")
    for i, (before, after) in enumerate(patterns):
        name = F.when(F.col("doc_id") % 6 == i, F.concat(F.lit(before), number, F.lit(after))).otherwise(name)
    docs = table(spark, sf, "documents").select("doc_id", name.alias("filename"))
    return docs.withColumn("extension", text.file_extension(F.col("filename")))


@query
def mime_detect(spark, sf):
    kind = F.col("doc_id") % 5
    body = F.col("text").cast("binary")
    content = (
        F.when(kind == 1, F.concat(F.lit(b"%PDF-1.7\n"), body))
        .when(kind == 2, F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), body))
        .when(kind == 3, F.concat(F.lit(b"\0\1\xff"), body))
        .when(kind == 4, F.concat(F.lit(b"\0\2\xff"), body)).otherwise(body)
    )
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), content.alias("content"),
        F.when(kind == 3, "audio/ogg").when(kind < 3, "text/x-declared").alias("declared"),
        F.when(kind == 4, "a.zip").otherwise("a.bin").alias("filename"),
    )
    pages = table(spark, sf, "pages").select(
        (-1 - F.col("page_id")).alias("id"), F.col("html").cast("binary").alias("content"),
        F.lit("").alias("declared"), F.lit("").alias("filename"),
    )
    both = docs.unionByName(pages)
    return both.select("id", mime.detect_mime(F.col("content"), F.col("declared"), F.col("filename")).alias("mime"))


@query
def b64url_decode(spark, sf):
    coded = _base64url(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", text.base64url_decode(coded).cast("string").alias("text"))


def _base64url(plain):
    return F.rtrim(F.translate(F.base64(plain.cast("binary")), "+/\r\n", "-_"), F.lit("="))


@query
def parse_date(spark, sf):
    # Each zone with the hours it is ahead of UTC; the last entry cannot be read.
    zones = [("+0000", 0), ("+0230", 2.5), ("-0500", -5), ("GMT", 0), ("EST", -5), ("-0000", 0), ("+0100 (CET)", 1), (None, 0)]
    shown = F.lit(None).cast("string")
    for i, (zone, hours) in enumerate(zones):
        local = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(hours * 60)))
        layout = "EEE, d MMM yyyy HH:mm:ss" if i % 2 else "dd MMM yyyy HH:mm:ss"
        written = F.concat(F.date_format(local, layout), F.lit(f" {zone}")) if zone else F.lit("next Tuesday, maybe")
        shown = F.when(F.col("event_id") % 8 == i, written).otherwise(shown)
    return table(spark, sf, "events").select("event_id", dates.parse_mail_date(shown).alias("date"))


@query
def html_to_text(spark, sf):
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(
        F.lit("<html><head><title>no</title><style>p {}</style></head><body><script>no()</script><p>"), escaped,
        F.lit("</p><img src='x.png'><h1>Title</h1><ul><li><b>one</b> &lt;</li><li><a href='http://x'>two</a> &amp; more</li></ul></body></html>"),
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", html.html_to_text(page).alias("text"))


@query
def html_pages(spark, sf):
    # The letters of the text: where lines break is a matter of taste.
    shown = html.html_to_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(shown, r"[^\p{L}]", "").alias("letters"))


@query
def attachment_text(spark, sf):
    small_batches(spark)
    kind, number = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    mail = F.concat(
        F.lit("From: a@x\nTo: b@x\nSubject: s "), number,
        F.lit("\nMIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"),
        F.base64(F.col("text").cast("binary")),
    )
    content = (
        F.when(kind == 0, F.concat(F.lit(b"\xff"), F.col("text").cast("binary")))
        .when(kind == 1, F.concat(F.lit('{"k": '), number, F.lit(', "l": [1]}')).cast("binary"))
        .when(kind == 2, F.concat(F.lit("<p>"), escaped, F.lit("</p>")).cast("binary"))
        .when(kind == 3, mail.cast("binary")).otherwise(F.col("text").cast("binary"))
    )
    mimes = F.element_at(F.array(*[F.lit(m) for m in (
        "text/plain", "application/json", "text/html", "message/rfc822", "video/mp4")]), (kind + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", files.attachment_text(mimes, content).alias("text"))


@query
def attachment_archive(spark, sf):
    """Archives of a document's text, with bytes that are no text, and its number."""
    @F.pandas_udf("binary")
    def packed(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        archives = []
        for body, number in zip(texts, numbers):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("in/a.TXT", b"\xff" * (number % 2) + (body or "").encode())
                archive.writestr("b.png", b"png")
                archive.writestr("c.json", str(number))
            archives.append(out.getvalue())
        return pd.Series(archives, dtype="object")

    archives = table(spark, sf, "documents").select("doc_id", packed("text", "doc_id").alias("content"))
    return archives.select("doc_id", files.attachment_text(F.lit(files.ARCHIVE), F.col("content")).alias("text"))


def _written_mbox(spark, sf):
    path = scratch_path(spark, "mbox")
    mbox.render_mbox(fixtures.emails(spark, sf)).write.text(path)
    return mbox.read_mbox(spark, path)


@query
def mbox_scan(spark, sf):
    found = F.regexp_extract(F.decode("value", "UTF-8"), r"(?m)^Message-ID: (.*)$", 1)
    return _written_mbox(spark, sf).groupBy(found.alias("message_id")).agg(F.count("*").alias("n"))


@query
def mbox_first(spark, sf):
    """The first half of an archive whose mails stand in the order of their ids."""
    emails = fixtures.emails(spark, sf)
    path = scratch_path(spark, "mbox")
    mbox.render_mbox(emails.orderBy("id")).write.text(path)
    half = mbox.read_mbox(spark, path, limit=emails.count() // 2)
    return ingest.emails_from(ingest.message_rows(mbox.parse_mbox(half))).select("id")


@query
def parse_mbox(spark, sf):
    rows = ingest.emails_from(ingest.message_rows(mbox.parse_mbox(_written_mbox(spark, sf))))
    return rows.select(
        "id", "thread_id", "subject", "in_reply_to", F.size("references").alias("n_references"), "date", "sender", "body",
    )


@query
def store_insert(spark, sf):
    """Half of the mails, then all of them, then all again, into one store."""
    store = MailStore(spark, scratch_path(spark, "store"))
    emails = fixtures.emails(spark, sf)
    for part in (emails.where("is_embedded"), emails, emails):
        path = scratch_path(spark, "mbox")
        mbox.render_mbox(part).write.text(path)
        store.insert_records(mbox.read_mbox(spark, path), mbox.MBOX)
    return store.emails().select("id", "thread_id", "subject", "in_reply_to", "date", "sender", "body")


def _multipart(spark, sf):
    """The emails as mbox text with encoded headers, folded ids, a text or an HTML part,
    and two files under one name, of which the last counts."""
    def encoded(text):
        return F.replace(F.base64(F.encode(text, "UTF-8")), F.lit("\r\n"), F.lit("\n"))

    emails = fixtures.emails(spark, sf)
    turn = F.regexp_extract("id", r"-([0-9]+)$", 1).cast("int")
    word = F.concat(F.lit("=?utf-8?B?"), F.base64(F.encode(F.concat(F.lit("Größe "), F.col("id")), "UTF-8")), F.lit("?="))
    page = F.concat(F.lit("<html><body><p>Answer <b>"), F.col("id"), F.lit("</b></p></body></html>"))
    text = F.when(turn % 2 == 1, F.concat(F.lit("Content-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), encoded(page)))
    text = text.otherwise(F.concat(F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), encoded(F.col("body"))))

    def file(content):
        return F.concat(
            F.lit("\n--cut\nContent-Type: text/plain\nContent-Disposition: attachment; filename=\"note.TXT\"\nContent-Transfer-Encoding: base64\n\n"),
            encoded(content))

    folded = F.when(turn % 3 == 0, "\n ").otherwise(" ")
    lines = F.concat(
        F.lit("From "), F.col("sender"), F.lit(" Mon Jan  1 08:00:00 2024\nSubject: "), word, F.lit("\nMessage-ID:"), folded, F.col("id"),
        F.lit("\nFrom: "), F.col("sender"), F.lit("\nDate: "), F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss '+0000'"),
        F.lit("\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=cut\n\n--cut\n"), text,
        file(F.lit("old")), file(F.concat(F.lit("file of "), F.col("id"))), F.lit("\n--cut--\n"))
    path = scratch_path(spark, "mbox")
    emails.select(lines.alias("value")).write.text(path)
    return mbox.read_mbox(spark, path)


@query
def parse_mbox_multipart(spark, sf):
    """Messages with parts through the store, twice; the second time nothing is new."""
    store = MailStore(spark, scratch_path(spark, "store"))
    for _ in range(2):
        store.insert_records(_multipart(spark, sf), mbox.MBOX)
    found = store.attachments().withColumnRenamed("id", "file_id")
    joined = store.emails().join(found, F.col("id") == F.col("email_id"))
    return joined.select("id", "subject", "sender", "date", "body", "filename", "extension", "mime_type", "size", "text_content")


@query
def quarantine(spark, sf):
    """Resources of which every seventh thread's cannot be read: these are set aside, the
    others are stored."""
    found = mailapi._envelope(_resources(spark, sf))
    broken = F.regexp_extract("resource_id", "^m([0-9]+)-", 1).cast("bigint") % 7 == 0
    raw = F.when(broken, F.regexp_replace("raw", '"parts":', '"parts":7,"_":')).otherwise(F.col("raw"))
    store = MailStore(spark, scratch_path(spark, "store"))
    store.insert_records(found.withColumn("raw", raw), mailapi.RESOURCES)
    aside = store.rejected().select(F.regexp_extract("place", r"(m[0-9]+-[0-9]+)\}", 1).alias("id"), F.lit(True).alias("rejected"))
    return store.emails().select("id", F.lit(False).alias("rejected")).unionByName(aside)


@query
def incremental_poll(spark, sf):
    """What a poll fetches after a store has taken the mail of the first ten days."""
    path = scratch_path(spark, "resources")
    _resources(spark, sf).write.text(path)
    found = mailapi.read_resources(spark, path)
    store = MailStore(spark, scratch_path(spark, "store"))
    limit = found.agg(F.min("internal_date") + 10 * 86_400_000).scalar()
    store.insert_records(found.where(F.col("internal_date") <= limit), mailapi.RESOURCES)
    return mailapi.since(found, store.mark()).select("resource_id", "internal_date")


def _resources(spark, sf):
    """The emails as mail-API resources in JSON."""
    def header(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    date = F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss '+0000'")
    body = F.named_struct(F.lit("data"), _base64url(F.col("body")))
    part = F.struct(F.lit("text/plain").alias("mimeType"), body.alias("body"))
    inner = F.struct(F.lit("multipart/alternative").alias("mimeType"), F.array(part).alias("parts"))
    resource = F.struct(
        F.col("id"), F.col("thread_id").alias("threadId"),
        F.when(F.col("is_embedded"), F.array(F.lit("INBOX"), F.lit("UNREAD"))).otherwise(F.array(F.lit("SENT"))).alias("labelIds"),
        F.timestamp_diff("MILLISECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), "date").cast("string").alias("internalDate"),
        F.struct(
            F.lit("multipart/mixed").alias("mimeType"),
            F.array(
                header("Message-ID", F.col("id")), header("SUBJECT", F.col("subject")), header("From", F.col("sender")),
                header("To", F.lit("first@example.com")), header("In-Reply-To", F.coalesce("in_reply_to", F.lit(""))),
                header("Date", date), header("to", F.lit("second@example.com")),
            ).alias("headers"),
            F.array(inner).alias("parts"),
        ).alias("payload"),
    )
    return fixtures.emails(spark, sf).select(F.to_json(resource).alias("value"))


@query
def header_map(spark, sf):
    found = mailapi._envelope(_resources(spark, sf))
    headers = F.col("headers")
    return found.select(
        F.col("resource_id").alias("id"), headers["subject"].alias("subject"), headers["to"].alias("last_to"),
        F.size(headers).alias("n"),
    )


@query
def gmail_scan(spark, sf):
    path = scratch_path(spark, "resources")
    _resources(spark, sf).write.text(path)
    found = mailapi.read_resources(spark, path)
    mark = found.agg(F.min("internal_date") + 5 * 86_400_000).scalar()
    return mailapi.inbox(found, mark).select("resource_id", "thread_id", "internal_date")


@query
def parse_gmail(spark, sf):
    parsed = mailapi.parse_resources(mailapi._envelope(_resources(spark, sf)))
    rows = ingest.emails_from(ingest.message_rows(parsed))
    return rows.select(
        "id", "thread_id", "subject", F.nullif("in_reply_to", F.lit("")).alias("in_reply_to"), "date", "sender",
        F.array_join("recipients", "|").alias("recipients"), "body",
    )


@query
def incremental_since(spark, sf):
    events = table(spark, sf, "events")
    mark = events.where(F.col("event_type") == "signup").agg(F.max("ts")).scalar()
    return events.where(F.col("ts") > mark).select("event_id", "ts")


# --- models, chunks, summaries, vectors --------------------------------------

def _modelled(spark, sf):
    # The catalogue has nine rows by definition.
    catalog = models.model_catalog(spark).withColumn("i", F.array_position(
        F.array(*[F.lit(m[0]) for m in models.MODELS]), F.col("model")) - 1)
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 9).alias("i"))
    return docs.join(F.broadcast(catalog), "i").withColumn("fits", F.col("n_chars") <= F.col("max_chars"))


@query
def char_budget(spark, sf):
    return _modelled(spark, sf).select("doc_id", "model", "max_chars", "fits")


@query
def model_catalog(spark, sf):
    return _modelled(spark, sf).groupBy("model", "kind", "dim", "max_tokens").agg(
        F.count("*").alias("documents"), F.count_if("fits").alias("whole"),
    )


@query
def chunk_documents(spark, sf):
    docs = table(spark, sf, "documents")
    chunks = chunking.chunk_text(F.col("text"), models.chunk_chars(CFG), CFG.separators)
    return chunking.explode_chunks(docs, chunks, "doc_id")


@query
def chunk_threads(spark, sf):
    chunks = chunking.chunk_text(F.col("text"), models.chunk_chars(CFG), CFG.separators)
    return chunking.explode_chunks(documents(spark, sf), chunks, "thread_id")


@query
def chunk_threads_resumed(spark, sf):
    """Two thirds of the mails as one batch, then the others, which fall into the middle
    and to the end of threads."""
    emails, attachments = fixtures.emails(spark, sf), fixtures.attachments(spark, sf)
    store = ThreadChunks(spark, scratch_path(spark, "thread-chunks"), CFG)
    late = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    early = emails.where(~late)
    store.update(0, early.select("thread_id", "id"), early, attachments.join(early.select(F.col("id").alias("email_id")), "email_id", "left_semi"))
    store.update(1, emails.where(late).select("thread_id", "id"), emails, attachments)
    return store.chunks()


def _counted(spark, sf):
    return chunked_documents(fixtures.emails(spark, sf), fixtures.attachments(spark, sf), CFG)


@query
def chunk_count(spark, sf):
    return _counted(spark, sf).select("thread_id", "chunk_count")


@query
def summarize_gate(spark, sf):
    return _counted(spark, sf).select("thread_id", "chunk_count", (F.col("chunk_count") > CFG.max_chunks).alias("is_summarized"))


@query
def summarize_threads(spark, sf):
    return summarize.summarize_documents(documents(spark, sf), CFG).select("thread_id", "summary")


@query
def summarize_hierarchical(spark, sf):
    narrow = MailConfig(context_tokens=1000, summary_sentences=2)
    return summarize.summarize_documents(documents(spark, sf), narrow).select("thread_id", "summary")


@query
def summarize_threads_idf(spark, sf):
    """Sentences by frequency in their thread times rarity in all threads."""
    # Stored, since the weights and the summaries read them several times.
    docs = stored(documents(spark, sf), "documents")
    weights = frequencies.WordWeights(docs, CFG.small_keys)
    summarizer = summarize.extractive(CFG.summary_sentences, weights)
    return summarize.summarize_documents(docs, CFG, summarizer).select("thread_id", "summary")


@query
def embed_chunks(spark, sf):
    vectors = embedding.hashed_terms(384, embedding.portable_hash)
    rows = chunk_threads(spark, sf).select("thread_id", "chunk_no", F.posexplode(vectors(F.col("text"))).alias("slot", "w"))
    return rows.where("w > 0").select("thread_id", "chunk_no", "slot", F.col("w").cast("double").alias("weight"))


@query
def embed_threads(spark, sf):
    run = build_threads(fixtures.emails(spark, sf), fixtures.attachments(spark, sf), CFG)
    names = [n for n in run.chunks.schema["metadata"].dataType.names if n != "thread_id"]
    return run.chunks.select("thread_id", "chunk_no", "text", *[f"metadata.{n}" for n in names])


@query
def embed_threads_segmented(spark, sf):
    run = build_threads(fixtures.emails(spark, sf), fixtures.attachments(spark, sf), SEGMENTED)
    names = [n for n in run.chunks.schema["metadata"].dataType.names if n != "thread_id"]
    return run.chunks.select("thread_id", "chunk_no", "text", *[f"metadata.{n}" for n in names])


@query
def vector_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    # A search has one question; here it is the first stored vector.
    question = vectors.orderBy("vec_id").select("embedding").first()[0]
    found = search.top_k(vectors, question, 10, tie="vec_id")
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


def _vector_index(spark, sf):
    """An index of all vectors, and every twentieth vector as a question."""
    vectors = table(spark, sf, "embeddings")
    index = VectorIndex(spark, scratch_path(spark, "vector-index"))
    index.build(vectors, ("vec_id",))
    return index, vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("question"), "embedding")


@query
def vector_topk_index(spark, sf):
    index, questions = _vector_index(spark, sf)
    found = index.search(questions, 10, exact=True)
    return found.select(F.col("question").alias("question_id"), "rank", "vec_id", F.round("score", 6).alias("score"))


@query
def vector_index_recall(spark, sf):
    """How many of the ten best rows each question finds in the cells it probes, and
    the share of all rows that it reads for them."""
    index, questions = _vector_index(spark, sf)
    near, best = (index.search(questions, 10, exact=exact).select("question", "vec_id") for exact in (False, True))
    hits = best.join(near.withColumn("hit", F.lit(1)), ["question", "vec_id"], "left").groupBy("question").agg(
        F.count("*").alias("best"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
    sizes = F.broadcast(index.cells().select("cell", "n"))
    total = index.cells().agg(F.sum("n")).first()[0]
    probed = index.probed(questions.withColumnRenamed("embedding", "v")).join(sizes, "cell").groupBy("question").agg(F.sum("n").alias("read"))
    share = F.round(F.col("read") / total, 4).alias("share_read")
    return hits.join(probed, "question").select(F.col("question").alias("question_id"), "best", "found", share)


@query
def metadata_filter(spark, sf):
    points = table(spark, sf, "embeddings").select("vec_id", F.struct("label").alias("metadata"))
    found = search.filter_collection(points, {"metadata.label": 3}, limit=20, order=["vec_id"])
    return found.select("vec_id", "metadata.label")


@on_emails
def collection_upsert(emails):
    stored = emails.select("id", "thread_id", F.col("body").alias("text"))
    changed = threads.pending_threads(emails)
    new = threads.rebuild_scope(emails, CFG).select("id", "thread_id", F.concat(F.lit("new "), "body").alias("text"))
    return collection.replace_threads(stored, new, changed)


@query
def collection_state(spark, sf):
    """Two batches: all emails as chunks, then the pending threads anew, of which
    some have no chunk left and some could not be embedded."""
    emails = fixtures.emails(spark, sf)
    number = F.regexp_extract("id", r"-(\d+)$", 1).cast("bigint").alias("chunk_no")
    kind = F.regexp_extract("thread_id", r"^m(\d+)-", 1).cast("bigint") % 7
    meta = F.lit(None).cast(COLLECTION["metadata"].dataType).alias("metadata")
    vector = F.array(F.lit(1.0).cast("float"))
    stored_ = collection.Collection(spark, scratch_path(spark, "collections"), "state")
    ids = emails.select("thread_id", "id")
    stored_.write_batch(0, emails.select("thread_id", number, F.col("body").alias("text"), vector.alias("embedding"), meta), ids, ids)
    scope = threads.rebuild_scope(emails, CFG).where(kind != 1)
    vector = F.when(kind != 2, vector)
    new = scope.select("thread_id", number, F.concat(F.lit("new "), "body").alias("text"), vector.alias("embedding"), meta)
    stored_.write_batch(1, new, threads.pending_threads(emails), ids.limit(0))
    folded = collection.Collection(spark, scratch_path(spark, "collections"), "folded")
    stored_.compact(folded)
    return folded.read().select("thread_id", "chunk_no", "text")


@query
def collection_filter(spark, sf):
    """The chunks of the thread with most mails, out of the bucket it lies in."""
    emails = fixtures.emails(spark, sf)
    number = F.regexp_extract("id", r"-(\d+)$", 1).cast("bigint").alias("chunk_no")
    meta = F.from_json(F.to_json(F.struct("thread_id")), COLLECTION["metadata"].dataType).alias("metadata")
    vector = F.array(F.lit(1.0).cast("float")).alias("embedding")
    ids = emails.select("thread_id", "id")
    stored_ = collection.Collection(spark, scratch_path(spark, "collections"), "filtered")
    stored_.write_batch(0, emails.select("thread_id", number, F.col("body").alias("text"), vector, meta), ids, ids)
    largest = emails.groupBy("thread_id").count().orderBy(F.desc("count"), "thread_id").first()["thread_id"]
    return stored_.find({"metadata.thread_id": largest}).select("thread_id", "chunk_no", "text")


# --- statistics and dumps ----------------------------------------------------

def _lengths(spark, sf):
    return documents(spark, sf).groupBy("thread_id").agg(F.sum(F.length("text")).cast("bigint").alias("text_block_len"))


@query
def length_stats(spark, sf):
    rounded = ("mean", "median", "p90", "p95", "p99", "stddev")
    found = stats.length_stats(_lengths(spark, sf))
    return found.select(*[F.round(c, 6).alias(c) if c in rounded else c for c in found.columns])


@query
def length_stats_sketch(spark, sf):
    """Sums, and whether the percentiles are within the error of the sketch."""
    lengths = stored(_lengths(spark, sf), "lengths")
    sketches = stats.LengthSketches(spark, scratch_path(spark, "sketches"))
    batch = F.crc32(F.encode("thread_id", "utf-8")) % 8
    for number in range(8):
        sketches.add(number, lengths.where(batch == number))
    sketches.add(0, lengths.where(batch == 0))
    found = stored(sketches.read(), "found")
    errors = stats.rank_errors(lengths, found)
    within = [(F.col(name) < stats.RANK_ERROR).alias(f"{name}_within") for name in stats.PERCENTILES]
    exact = found.select("threads", F.round("mean", 6).alias("mean"), "min", "max", F.round("stddev", 6).alias("stddev"))
    # One row each.
    return exact.withColumn("_one", F.lit(1)).join(errors.select(*within, F.lit(1).alias("_one")), "_one").drop("_one")


@query
def length_histogram(spark, sf):
    return stats.length_histogram(_lengths(spark, sf))


@query
def thread_dump(spark, sf):
    return documents(spark, sf).select("thread_id", text.indent_block(F.col("text")).alias("block"))


@query
def dump_scan(spark, sf):
    path = scratch_path(spark, "dump")
    lengths = F.struct(F.length("text").cast("bigint").alias("text_block_len"))
    dumped = documents(spark, sf).select(lengths.alias("metadata"), "text", F.lit(None).cast("string").alias("summary"))
    dump.write_dump(dumped, path)
    found = dump.read_dump_lengths(spark, path)
    return found.groupBy("text_block_len").agg(F.count("*").alias("threads"))
