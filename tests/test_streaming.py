"""Stored collections and the two streams."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mailspark.config import MailConfig
from mailspark.operators.collection import Collection, mark_embedded, replace_threads
from mailspark.operators.dump import read_dump_lengths
from mailspark.operators import threads
from mailspark.operators.embedding import model_embedder
from mailspark.plans.ingest import MailStore
from mailspark.plans.threads import build_threads
from mailspark.schemas import COLLECTION, EMAILS
from mailspark.sources import fixtures
from mailspark.sources.mbox import parse_mbox, read_mbox, stream_mbox
from mailspark.streaming import jobs

CFG = MailConfig(chunk_size=200)


def record(id, body, parent=None, root=None, minute=0):
    headers = [f"Message-ID: <{id}@x>", f"Subject: about {root or id}", "From: a@x", "To: b@x",
               f"Date: Mon, 01 Jan 2024 10:{minute:02d}:00 +0000"]
    if parent:
        headers += [f"In-Reply-To: <{parent}@x>", f"References: <{root or parent}@x>"]
    return ("From a@x Mon Jan  1 00:00:00 2024\n" + "\n".join(headers) + f"\n\n{body}\n").encode()


FIRST = [record("r1", "root one", minute=5), record("a1", "answer", "r1", "r1", 6), record("r2", "root two", minute=7)]
SECOND = [record("a1", "copy of the answer", "r1", "r1", 6), record("late", "late reply", "r1", "r1", 1), record("r3", "new thread", minute=9),
          record("b2", "x\nOn day y wrote:\nroot two", "r2", "r2", 8)]


def by_thread(frame):
    got = {}
    for row in frame.orderBy("thread_id", "chunk_no").collect():
        got.setdefault(row.thread_id, []).append(row.text)
    return got


def test_streams_equal_batch(spark, tmp_path):
    drop, store = tmp_path / "drop", MailStore(spark, str(tmp_path / "store"))
    drop.mkdir()
    collection = Collection(spark, str(tmp_path / "collections"), CFG.collection_name)
    collection.create(CFG.embed_model)

    def poll():
        jobs.ingest_stream(stream_mbox(spark, str(drop)), parse_mbox, store, str(tmp_path / "c1"), once=True).awaitTermination()
        jobs.embed_stream(store, collection, str(tmp_path / "c2"), CFG, once=True, dump=str(tmp_path / "dump")).awaitTermination()

    (drop / "1.mbox").write_bytes(b"".join(FIRST))
    poll()
    before = by_thread(collection.read())
    assert set(before) == {"<r1@x>", "<r2@x>"} and "answer" in "".join(before["<r1@x>"])

    (drop / "2.mbox").write_bytes(b"".join(SECOND))
    poll()
    after = by_thread(collection.read())
    assert set(after) == {"<r1@x>", "<r2@x>", "<r3@x>"}
    whole = "".join(after["<r1@x>"])
    # The late reply is dated first, so it became email 1; the copy was ignored.
    assert whole.index("late reply") < whole.index("root one") and "copy of" not in whole
    assert "On day y wrote" not in "".join(after["<r2@x>"])

    for name, records in (("a", FIRST), ("b", SECOND)):
        (tmp_path / f"{name}.mbox").write_bytes(b"".join(records))
    batch = MailStore(spark, str(tmp_path / "batch"))
    for name in "ab":
        batch.insert_new(parse_mbox(read_mbox(spark, str(tmp_path / f"{name}.mbox"))))
    run = build_threads(batch.emails(), batch.attachments(), CFG)
    assert by_thread(run.chunks) == after
    assert build_threads(mark_embedded(store.emails(), collection.embedded()), store.attachments(), CFG).changed.count() == 0
    few = spark.createDataFrame([("<r3@x>",)], "thread_id string")
    emails, _ = store.near_threads(few)
    assert {r.thread_id for r in emails.collect()} >= {"<r3@x>"} and emails.count() < store.emails().count()
    assert store.near_threads(few, 0)[0].count() == store.emails().count()
    assert read_dump_lengths(spark, str(tmp_path / "dump" / "batch=*")).count() == 5


def test_no_writer_loses_mail_of_another(spark, tmp_path):
    """A load, two streams, a stream with a fresh checkpoint, and repeated batches."""
    store, ids = MailStore(spark, str(tmp_path / "store")), set()

    def drop(folder, *names):
        (tmp_path / folder).mkdir(exist_ok=True)
        for name in names:
            (tmp_path / folder / f"{name}.mbox").write_bytes(record(name, f"body of {name}"))
            ids.add(f"<{name}@x>")
        return str(tmp_path / folder)

    def poll(folder, checkpoint):
        jobs.ingest_stream(stream_mbox(spark, folder), parse_mbox, store, str(tmp_path / checkpoint), once=True).awaitTermination()

    store.insert_new(parse_mbox(read_mbox(spark, drop("load", "l1", "l2"))))
    poll(drop("s1", "a1", "a2"), "c1")
    poll(drop("s2", "b1"), "c2")
    poll(drop("s1", "a3"), "c1")
    poll(drop("s1", "a4"), "fresh")
    store.insert_new(parse_mbox(read_mbox(spark, drop("load2", "l3"))))
    got = [r.id for r in store.emails().collect()]
    assert set(got) == ids and len(got) == len(ids)
    # A batch that is run again after its commit changes nothing.
    store.insert_new(parse_mbox(read_mbox(spark, drop("one", "w1"))), 0, writer="w")
    store.insert_new(parse_mbox(read_mbox(spark, drop("two", "w2"))), 0, writer="w")
    ids.discard("<w2@x>")
    assert {r.id for r in store.emails().collect()} == ids
    # Rows without a commit are not there, and do not hide a message from the next batch.
    store._write_sorted(store._read("emails").where("id = '<l1@x>'").withColumn("id", F.lit("<ghost@x>")).drop("writer", "batch"), "emails", "dead", 3)
    assert {r.id for r in store.emails().collect()} == ids
    store.insert_new(parse_mbox(read_mbox(spark, drop("three", "ghost"))))
    assert {r.id for r in store.emails().collect()} == ids
    folded = MailStore(spark, str(tmp_path / "folded"))
    store.compact(folded)
    assert {r.id for r in folded.emails().collect()} == ids and folded.emails().count() == len(ids)
    assert folded.committed("w", 0) and not folded.committed("w", 1)


class Mails:
    """A store of six emails in three threads."""

    def __init__(self, spark):
        rows = [(str(i), f"t{i % 3}", "s", [], None, datetime(2024, 1, 1), "a", [], f"text {i}", False) for i in range(6)]
        self.frame = spark.createDataFrame(rows, EMAILS)

    def emails(self):
        return self.frame

    def near_threads(self, threads, small):
        return self.frame, None


def test_failed_batch_leaves_no_trace(spark, tmp_path):
    collection = Collection(spark, str(tmp_path), "c")

    def broken(text):
        return F.raise_error(F.lit("model is down")).cast("array<float>")

    with pytest.raises(Exception, match="model is down"):
        jobs.embed_pending(Mails(spark), collection, 0, CFG, broken)
    assert collection.read().count() == 0 and collection.embedded().count() == 0
    for _ in range(2):
        jobs.embed_pending(Mails(spark), collection, 0, CFG, touched=Mails(spark).emails())
        assert set(by_thread(collection.read())) == {"t0", "t1", "t2"} and collection.embedded().count() == 6
    jobs.embed_pending(Mails(spark), collection, 1, CFG)
    assert set(by_thread(collection.read())) == {"t0", "t1", "t2"} and collection.embedded().count() == 6


def test_failed_thread_stays_pending(spark, tmp_path):
    collection = Collection(spark, str(tmp_path), "c")

    def load():
        def vectors(texts):
            if any("text 1" in t for t in texts):
                raise RuntimeError("bad text")
            return [[1.0] for _ in texts]
        return vectors

    jobs.embed_pending(Mails(spark), collection, 0, CFG, model_embedder(load))
    assert set(by_thread(collection.read())) == {"t0", "t2"} and collection.embedded().count() == 4
    assert [r.thread_id for r in collection.failed_threads().collect()] == ["t1"]
    none = Mails(spark).emails().limit(0)
    jobs.embed_pending(Mails(spark), collection, 1, CFG, touched=none)
    assert set(by_thread(collection.read())) == {"t0", "t1", "t2"} and collection.embedded().count() == 6
    assert collection.failed_threads().count() == 0
    # A failure of a thread that has chunks leaves the old ones in place.
    old = by_thread(collection.read())
    jobs.embed_pending(Mails(spark), collection, 2, CFG, model_embedder(load), touched=Mails(spark).emails())
    assert by_thread(collection.read()) == old
    assert by_thread(collection.read(small=0)) == old


def test_empty_thread_loses_its_chunks(spark, tmp_path):
    collection = Collection(spark, str(tmp_path), "c")
    row = ("t", 0, "old", [1.0], None)
    schema = COLLECTION
    changed = spark.createDataFrame([("t",), ("u",)], "thread_id string")
    ids = spark.createDataFrame([("t", "1"), ("u", "2")], "thread_id string, id string")
    collection.write_batch(0, spark.createDataFrame([row, ("u", 0, "kept", [1.0], None)], schema), changed, ids)
    collection.write_batch(1, spark.createDataFrame([], schema), changed.where("thread_id = 't'"), ids.limit(0))
    assert by_thread(collection.read()) == {"u": ["kept"]}
    assert collection.embedded().count() == 2
    collection.create("bge-m3")
    # Another batch in which u fails keeps its chunks and the failure.
    collection.write_batch(2, spark.createDataFrame([("u", 0, "newer", None, None)], schema), changed.where("thread_id = 'u'"), ids.limit(0))
    folded = Collection(spark, str(tmp_path), "d")
    collection.compact(folded)
    assert by_thread(folded.read()) == {"u": ["kept"]} and folded.embedded().count() == 2
    assert [r.thread_id for r in folded.failed_threads().collect()] == ["u"]
    with pytest.raises(ValueError):
        folded.create("e5-base-v2")


def test_a_thread_is_found_in_its_bucket(spark, tmp_path):
    collection = Collection(spark, str(tmp_path), "c")
    rows = [(f"t{i % 40}", i, f"text {i}", [1.0], None) for i in range(400)]
    chunks = spark.createDataFrame(rows, COLLECTION)
    ids = chunks.select("thread_id", F.col("text").alias("id"))
    collection.write_batch(0, chunks, ids, ids)
    collection.write_batch(1, chunks.where("thread_id = 't7' AND chunk_no < 50"), ids.where("thread_id = 't7'"), ids.limit(0))
    found = collection.find({"thread_id": "t7"}, order=["chunk_no"])
    assert [(r.thread_id, r.chunk_no) for r in found.collect()] == [("t7", 7), ("t7", 47)]
    assert collection.find({"thread_id": "t8"}, limit=3, order=["chunk_no"]).count() == 3
    assert collection.find({"thread_id": "none"}).collect() == []
    assert collection.find({"text": "text 9"}).count() == 1
    plan = collection.find({"metadata.thread_id": "t7"})._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "bucket#" in line)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", scan)
    folders = {f.split("bucket=")[1].split("/")[0] for f in spark.read.parquet(f"{collection.path}/chunks").inputFiles()}
    assert len(folders) > 10


def test_create_is_idempotent(spark, tmp_path):
    collection = Collection(spark, str(tmp_path), "c")
    collection.create("bge-m3")
    collection.create("bge-m3")
    with pytest.raises(ValueError):
        collection.create("e5-base-v2")


def test_replace_threads(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "thread_id string, v int")
    new = spark.createDataFrame([("a", 3)], "thread_id string, v int")
    changed = spark.createDataFrame([("a",), ("c",)], "thread_id string")
    assert {tuple(r) for r in replace_threads(old, new, changed).collect()} == {("a", 3), ("b", 2)}


@pytest.mark.parametrize("heavy", [1, 700, 2000])
@pytest.mark.parametrize("options", [{"max_chunks": 10**6}, {}, {"context_tokens": 1000, "summary_sentences": 2}])
def test_results_do_not_depend_on_size(spark, sf, heavy, options):
    """Every chunk row of threads in segments is that of the whole thread: number,
    text, counts, summary; and so are the entries of a dump."""
    emails, files = fixtures.emails(spark, sf), fixtures.attachments(spark, sf)
    light = build_threads(emails, files, MailConfig(**options))
    large = build_threads(emails, files, MailConfig(heavy_chars=heavy, **options))
    rows = lambda run: sorted(map(str, run.chunks.collect()))
    assert rows(large) == rows(light)
    summaries = lambda run: {r.thread_id: r.summary for r in run.threads.where("summary is not null").collect()}
    assert summaries(large) == summaries(light)
    assert large.threads.where("metadata is not null").count() == light.threads.count()
    assert large.threads.count() > light.threads.count() or heavy > 1000


def test_live_metadata(spark, sf, tmp_path):
    emails = fixtures.emails(spark, sf)
    emails.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(emails.schema).parquet(str(tmp_path / "in"))
    query = jobs.live_metadata(stream).writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("live").collect()}
    assert got == {tuple(r) for r in jobs.live_metadata(emails).collect()} and got
    files = fixtures.attachments(spark, sf).join(emails.select(F.col("id").alias("email_id"), "thread_id"), "email_id")
    counts = {r.thread_id: r.attachments_count for r in jobs.live_metadata(emails, files).collect()}
    assert counts == {r.thread_id: r.attachments_count for r in threads.thread_metadata(emails, fixtures.attachments(spark, sf)).collect()}
    assert sum(counts.values()) > 0


def test_live_metadata_counts_repeated_arrivals_once(spark, sf, tmp_path):
    """Mails that come again in a later batch, after a restart, count once."""
    emails = fixtures.emails(spark, sf)
    folder, seen = str(tmp_path / "in"), []

    def arrive(mails):
        mails.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(emails.schema).parquet(folder)
        writer = jobs.live_metadata(stream).writeStream.outputMode("complete").trigger(availableNow=True)
        writer = writer.foreachBatch(lambda batch, _: seen.append({tuple(r) for r in batch.collect()}))
        writer.option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()

    early = F.crc32(F.encode("id", "utf-8")) % 2 == 0
    arrive(emails.where(early).union(emails.where(early)))
    arrive(emails)
    want = {tuple(r) for r in jobs.live_metadata(emails).collect()}
    assert seen[-1] == want and seen[0] != want
    assert sum(r[3] for r in want) == emails.count()
    attached = fixtures.attachments(spark, sf).join(emails.select(F.col("id").alias("email_id"), "thread_id"), "email_id")
    assert {tuple(r) for r in jobs.live_metadata(emails, attached).collect()} == {
        tuple(r) for r in jobs.live_metadata(emails.union(emails), attached.union(attached)).collect()}
