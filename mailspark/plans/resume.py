"""Chunks of thread documents that go on where a late mail changes them.

Chunks are packed greedily from the start of a document, so a mail changes nothing
before the pack it falls into. ``ThreadChunks`` keeps, beside the chunks of every thread,
where its packs begin: the mail, the number of the first chunk and the characters before.
An update finds for each touched thread the first mail that it changes (a new one, or a
reply that now has its parent), goes back to the pack before, reads the bodies from there
on, and replaces the chunks from there on. What is kept is never read.

A pack is resumed only if what lies before it is longer than a chunk. Then the document
is too, whatever the update does, and the chunks are those of a full rebuild. Threads
with a mail that contains a mark of the document layout have more packs than mails can
tell; they are rebuilt from the start, by the plain path.

Tables are batches with a commit written last, as in the other stores. A batch's ``cuts``
say from which chunk and pack on older rows of a thread do not count any more. Mails may
be added, not taken away.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark.config import MailConfig
from mailspark.functions.text import remove_links
from mailspark.operators.chunking import chunk_text
from mailspark.operators.quotes import strip_quotes
from mailspark.operators.skew import KeySet, running_sums, small_side
from mailspark.operators.threads import (
    END_EMAIL, END_THREAD, LAYOUT, attachment_block, document_head, email_head, has_text,
)
from mailspark.plans.threads import document_chunks
from mailspark.session import read_table, scratch_scope, stored
from mailspark.sources.models import chunk_chars

_THREAD = [T.StructField("thread_id", T.StringType()), T.StructField("bucket", T.IntegerType())]
_BATCH = T.StructField("batch", T.LongType())
_LONG = T.LongType()
_PARTS = {
    "chunks": T.StructType([*_THREAD, T.StructField("chunk_no", _LONG), T.StructField("text", T.StringType()), _BATCH]),
    "packs": T.StructType([
        *_THREAD, T.StructField("pack_no", _LONG), T.StructField("date", T.TimestampNTZType()), T.StructField("id", T.StringType()),
        T.StructField("before", _LONG), T.StructField("first_chunk", _LONG), _BATCH]),
    # ``marked`` threads hold a mark of the layout in a mail.
    "cuts": T.StructType([
        *_THREAD, T.StructField("from_pack", _LONG), T.StructField("from_chunk", _LONG), T.StructField("marked", T.BooleanType()), _BATCH]),
    "commits": T.StructType([T.StructField("done", T.IntegerType()), _BATCH]),
}
_MARK = LAYOUT.mark
# Older mails that a scan looks for by id.
_FEW = 64
# What follows the last mail's text, up to the end mark of the thread.
_CLOSE = f"{_MARK}\n\n"


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def mail_pieces(mails: DataFrame, files: DataFrame | None, heads: DataFrame) -> DataFrame:
    """``thread_id, date, id, piece`` of every mail with a text: the stretch of the
    document from the end mark of the mail before (or the document's head) to its own.

    ``mails`` have ``n``, ``text`` and ``resumed``; ``heads (_head_id, head)`` names those
    that come first.
    """
    mails = mails.where(F.col("text") != "").join(small_side(heads, 20_000), F.col("id") == F.col("_head_id"), "left")
    blocks = F.lit("")
    if files is not None:
        block = F.struct("filename", "id", attachment_block(F.col("filename"), F.col("extension"), F.col("text_content")).alias("block"))
        listed = files.where(has_text()).groupBy(F.col("email_id").alias("_mail")).agg(F.array_sort(F.collect_list(block)).alias("blocks"))
        mails = mails.join(listed, F.col("id") == F.col("_mail"), "left")
        blocks = F.coalesce(F.array_join(F.transform("blocks", lambda b: b["block"]), ""), F.lit(""))
    piece = F.concat(
        F.coalesce("head", F.lit(_MARK)), F.lit("\n\n"), email_head(F.col("n"), F.col("date"), F.col("text")), blocks, F.lit("\n"))
    return mails.select("thread_id", "date", "id", "resumed", remove_links(piece).alias("piece"))


def _packed(pieces: DataFrame, size: int) -> DataFrame:
    """``thread_id, pack, place, id, before, closing``: the pack of every piece, by a pass
    over lengths. Rows without id close a document: with ``closing`` as their text."""
    names = ["thread_id", "pack", "place", "id", "before", "closing"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        thread, seen, resumed = None, False, False
        pack = place = open_ = total = 0

        def add(length: int, id_: str | None, closing: str | None) -> None:
            nonlocal pack, place, open_, total
            if place and open_ + length > size:
                pack, open_ = pack + 1, 0
            out.append((thread, pack, place, id_, total, closing))
            open_, total, place = open_ + length, total + length, place + 1

        def close() -> None:
            nonlocal pack
            if not resumed and total + len(_CLOSE) + len(END_THREAD) <= size:
                add(len(_CLOSE), None, _CLOSE + END_THREAD)
            else:
                add(len(_CLOSE), None, _CLOSE)
                pack += 1
                out.append((thread, pack, place, None, total, END_THREAD))

        def flush() -> pa.RecordBatch:
            rows = out[:]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names)

        for batch in batches:
            for row in batch.to_pylist():
                if not seen or row["thread_id"] != thread:
                    if seen:
                        close()
                    thread, seen, resumed = row["thread_id"], True, row["resumed"]
                    pack = place = open_ = total = 0
                add(row["length"], row["id"], None)
            if out:
                yield flush()
        if seen:
            close()
            yield flush()

    narrow = pieces.select("thread_id", "date", "id", "resumed", F.length("piece").alias("length"))
    dealt = narrow.repartition("thread_id").sortWithinPartitions("thread_id", "date", "id")
    return dealt.mapInArrow(run, "thread_id string, pack bigint, place bigint, id string, before bigint, closing string")


class ThreadChunks:
    """Chunks of all threads below a root folder all executors share."""

    def __init__(self, spark: SparkSession, root: str, cfg: MailConfig = MailConfig(), buckets: int = 1024):
        self.spark = spark
        self.root = root.rstrip("/")
        self.cfg = cfg
        self.buckets = buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("thread_id"), F.lit(self.buckets)).cast("int")

    def _committed(self, part: str) -> DataFrame:
        commits = small_side(self._read("commits").select("batch").distinct(), self.cfg.small_keys)
        return self._read(part).join(commits, "batch", "left_semi")

    def _read(self, part: str) -> DataFrame:
        return read_table(self.spark, f"{self.root}/{part}", _PARTS[part])

    def _write(self, rows: DataFrame, part: str, batch: int) -> None:
        names = [n for n in _PARTS[part].names if n != "batch"]
        if "bucket" in names:
            rows = rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        ordered = [n for n in ("bucket", "thread_id", "pack_no", "chunk_no") if n in names]
        rows = rows.select(*names)
        rows = rows.sortWithinPartitions(*ordered) if ordered else rows.coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.root}/{part}/batch={batch}")

    def _live(self, part: str, number: str, since: str, threads: KeySet | None = None) -> DataFrame:
        """Rows that no later batch has cut off."""
        rows, cuts = self._committed(part), self._committed("cuts")
        if threads is not None:
            rows, cuts = threads.inside(rows), threads.inside(cuts)
        cuts = cuts.select(F.col("thread_id").alias("_thread"), F.col("batch").alias("_later"), F.col(since).alias("_from"))
        later = _same("thread_id", "_thread") & (F.col("_later") > F.col("batch")) & (F.col("_from") <= F.col(number))
        return rows.join(small_side(cuts, self.cfg.small_keys), later, "left_anti")

    def chunks(self) -> DataFrame:
        """``thread_id, chunk_no, text``: the current chunks of all threads."""
        return self._live("chunks", "chunk_no", "from_chunk").select("thread_id", "chunk_no", "text")

    def update(self, batch: int, new: DataFrame, emails: DataFrame, attachments: DataFrame | None = None) -> None:
        """Takes the mails ``new (thread_id, id)``, which ``emails`` and
        ``attachments`` already hold. A batch that is run again replaces itself; one
        that was committed is left as it is."""
        if not self._read("commits").where(F.col("batch") == batch).isEmpty():
            return
        with scratch_scope(self.spark):
            self._update(batch, new, emails, attachments)

    def _resume_points(self, threads: KeySet, order: DataFrame, new: DataFrame) -> DataFrame:
        """``thread_id, from_pack, from_chunk, key``: where each touched thread goes on;
        ``key`` is null where it starts anew."""
        fresh = new.select(F.col("thread_id").alias("_thread"), F.col("id").alias("_new")).distinct()
        own = order.join(fresh, _same("thread_id", "_thread") & (F.col("id") == F.col("_new"))).select("thread_id", "key")
        replies = order.join(fresh, _same("thread_id", "_thread") & (F.col("in_reply_to") == F.col("_new"))).select("thread_id", "key")
        changed = own.unionByName(replies).groupBy("thread_id").agg(F.min("key").alias("change"))
        packs = self._live("packs", "pack_no", "from_pack", threads).where(F.col("before") > chunk_chars(self.cfg))
        marked = threads.inside(self._committed("cuts")).groupBy(F.col("thread_id").alias("_cut")).agg(F.max("marked").alias("marked"))
        packs = packs.select(F.col("thread_id").alias("_of"), F.struct("date", "id").alias("key"), "pack_no", "first_chunk", "before")
        met = changed.join(packs, _same("thread_id", "_of") & (F.col("key") < F.col("change")), "left")
        best = met.groupBy("thread_id").agg(F.max_by(F.struct("key", "pack_no", "first_chunk", "before"), "pack_no").alias("p"))
        best = best.join(marked, _same("thread_id", "_cut"), "left")
        usable = F.col("p.key").isNotNull() & ~F.coalesce("marked", F.lit(False))
        return best.select(
            "thread_id", F.when(usable, F.col("p.pack_no")).otherwise(0).alias("from_pack"),
            F.when(usable, F.col("p.first_chunk")).otherwise(0).alias("from_chunk"),
            F.when(usable, F.col("p.before")).otherwise(0).alias("chars"), F.when(usable, F.col("p.key")).alias("from_key"))

    def _update(self, batch: int, new: DataFrame, emails: DataFrame, attachments: DataFrame | None) -> None:
        cfg, size = self.cfg, chunk_chars(self.cfg)
        threads = KeySet(new.select("thread_id").distinct(), "thread_id", cfg.small_keys)
        # Order, parents and numbers need no bodies.
        narrow = threads.inside(emails.select("thread_id", "date", "id", "in_reply_to"))
        order = running_sums(narrow, "thread_id", ["date", "id"], {"n": F.lit(1).cast("bigint")}, cfg.heavy_rows, cfg.small_keys)
        order = stored(order.withColumn("key", F.struct("date", "id")), "order")
        points = stored(self._resume_points(threads, order, new), "points")
        at = small_side(points.withColumnRenamed("thread_id", "_at"), cfg.small_keys)
        scope = order.join(at, _same("thread_id", "_at")).where(F.col("from_key").isNull() | (F.col("key") >= F.col("from_key")))
        scope = stored(scope.select("thread_id", "id", "n", F.col("from_key").isNotNull().alias("resumed"), "in_reply_to"), "scope")

        # Bodies of the changed mails, of their parents, and of the first mails of threads.
        roots = order.where("n = 1").select("id")
        wanted = scope.select("id").unionByName(scope.select(F.col("in_reply_to").alias("id")).where("id IS NOT NULL")).unionByName(roots)
        wanted = wanted.distinct()
        near = self._since(emails, points, order, wanted)
        mails = stored(threads.inside(KeySet(wanted, "id", cfg.small_keys).inside(near)), "mails")
        # Stored, since the heads and the pieces read it and the diff should run once.
        texts = stored(strip_quotes(mails, cfg).join(
            scope.select(F.col("id").alias("_scope"), "n", "resumed"), F.col("id") == F.col("_scope")), "texts")
        files = None
        if attachments is not None:
            files = KeySet(scope.select(F.col("id").alias("email_id")).distinct(), "email_id", cfg.small_keys).inside(attachments)
        # The head stands before the first mail with a text of a thread that starts anew.
        opening = texts.where(~F.col("resumed") & (F.col("text") != "")).groupBy("thread_id").agg(
            F.min(F.struct("date", "id")).alias("first"))
        subjects = mails.join(roots.withColumnRenamed("id", "_root"), F.col("id") == F.col("_root")).select(
            F.col("thread_id").alias("_of"), document_head(F.col("subject")).alias("head"))
        heads = stored(opening.join(subjects, _same("thread_id", "_of")).select(F.col("first.id").alias("_head_id"), "head"), "heads")
        pieces = stored(mail_pieces(texts, files, heads), "pieces")
        self._write_batch(batch, points, pieces, emails, attachments, size)

    def _since(self, emails: DataFrame, points: DataFrame, order: DataFrame, wanted: DataFrame) -> DataFrame:
        """``emails`` with a filter on date that the scan can use, if all threads go on
        somewhere and few older mails are needed."""
        facts = points.agg(F.max(F.col("from_key").isNull()).alias("anew"), F.min("from_key.date").alias("least")).first()
        if facts["anew"] is not False or facts["least"] is None:
            return emails
        older = order.where(F.col("date") < F.lit(facts["least"])).join(wanted.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"))
        ids = [r[0] for r in older.select("id").limit(_FEW + 1).collect()]
        if len(ids) > _FEW:
            return emails
        return emails.where((F.col("date") >= F.lit(facts["least"])) | F.col("id").isin(ids))

    def _write_batch(
        self, batch: int, points: DataFrame, pieces: DataFrame, emails: DataFrame, attachments: DataFrame | None, size: int,
    ) -> None:
        cfg = self.cfg
        inside = F.substring("piece", 2, 1 << 30)
        odd = inside.contains(_MARK) | inside.contains(LAYOUT.head) | inside.contains(END_THREAD)
        marked = stored(pieces.where(odd).select("thread_id").distinct(), "marked")
        plain = KeySet(marked, "thread_id", cfg.small_keys)
        packed = stored(_packed(plain.outside(pieces), size), "packed")

        keyed = pieces.select(F.col("id").alias("_id"), "piece", "date")
        parts = packed.join(keyed, F.col("id") == F.col("_id"), "left").select(
            "thread_id", "pack", "place", F.coalesce("closing", "piece").alias("part"))
        listed = F.array_sort(F.collect_list(F.struct("place", "part")))
        whole = parts.groupBy("thread_id", "pack").agg(F.array_join(F.transform(listed, lambda p: p["part"]), "").alias("text"))
        lower = cfg.separators[cfg.separators.index(_MARK) + 1:]
        chunked = stored(whole.select("thread_id", "pack", chunk_text(F.col("text"), size, lower).alias("chunks")), "chunked")

        upto = Window.partitionBy("thread_id").orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)
        counts = chunked.select("thread_id", "pack", F.size("chunks").alias("number")).withColumn(
            "earlier", F.coalesce(F.sum("number").over(upto), F.lit(0)))
        at = small_side(points.withColumnRenamed("thread_id", "_at"), cfg.small_keys)
        first = counts.join(at, _same("thread_id", "_at")).select(
            F.col("thread_id").alias("_of"), F.col("pack").alias("_pack"), (F.col("earlier") + F.col("from_chunk")).alias("first_chunk"),
            "from_pack", "chars")
        first = stored(first, "first")
        here = _same("thread_id", "_of") & (F.col("pack") == F.col("_pack"))
        rows = chunked.join(first, here).select("thread_id", "first_chunk", F.posexplode("chunks").alias("at", "text"))
        rows = rows.select("thread_id", (F.col("first_chunk") + F.col("at")).alias("chunk_no"), "text")
        if not plain.empty:
            rows = rows.unionByName(self._rebuilt(marked, emails, attachments))
        self._write(rows, "chunks", batch)

        begin = packed.where("id IS NOT NULL").groupBy("thread_id", "pack").agg(F.min_by(F.struct("id", "before"), "place").alias("b"))
        begin = begin.join(first, here).join(keyed.drop("piece"), F.col("b.id") == F.col("_id"))
        self._write(begin.select(
            "thread_id", (F.col("pack") + F.col("from_pack")).alias("pack_no"), "date", F.col("b.id").alias("id"),
            (F.col("b.before") + F.col("chars")).alias("before"), "first_chunk"), "packs", batch)
        is_marked = marked.select(F.col("thread_id").alias("_odd"), F.lit(True).alias("is_marked"))
        cuts = points.join(is_marked, _same("thread_id", "_odd"), "left")
        odd_thread = F.coalesce("is_marked", F.lit(False))
        self._write(cuts.select(
            "thread_id", *[F.when(odd_thread, 0).otherwise(F.col(c)).alias(c) for c in ("from_pack", "from_chunk")],
            odd_thread.alias("marked")), "cuts", batch)
        self._write(self.spark.range(1).select(F.lit(1).alias("done")), "commits", batch)

    def _rebuilt(self, threads: DataFrame, emails: DataFrame, attachments: DataFrame | None) -> DataFrame:
        """Chunks of whole threads by the plain path."""
        scope = KeySet(threads, "thread_id", self.cfg.small_keys).inside(emails)
        documents, large = document_chunks(scope, attachments, self.cfg)
        size = chunk_chars(self.cfg)
        found = documents.where("whole").select("thread_id", F.posexplode(
            F.coalesce("chunks", chunk_text(F.col("text"), size, self.cfg.separators))).alias("chunk_no", "text"))
        found = found.withColumn("chunk_no", F.col("chunk_no").cast("bigint"))
        return found if large is None else found.unionByName(large.select("thread_id", "chunk_no", "text"))
