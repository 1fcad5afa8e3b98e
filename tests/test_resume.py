import random

import pytest
from pyspark.sql import functions as F

from mailspark.config import MailConfig
from mailspark.operators.chunking import chunk_text
from mailspark.operators.threads import END_EMAIL, thread_documents
from mailspark.plans.resume import ThreadChunks
from mailspark.schemas import ATTACHMENTS, EMAILS

CFG = MailConfig(chunk_size=400)


def mail(thread, n, body, parent=None, day=None):
    from datetime import datetime, timedelta
    date = datetime(2024, 1, 1) + timedelta(days=n if day is None else day)
    return (f"{thread}-{n}", thread, f"topic {thread} http://x.org/{n}", [], parent, date, "a@b", ["c@d"], body, False)


def body(rng, words):
    return " ".join(rng.choice(["one", "two", "three.", "four\n\n", "five\n", "www.x.org/a"]) for _ in range(words))


def table(spark, rows):
    return spark.createDataFrame(rows, EMAILS)


def files(spark, rows):
    return spark.createDataFrame(rows, ATTACHMENTS)


def rebuilt(emails, attachments, cfg=CFG):
    """The chunks of whole documents, in one go."""
    documents = thread_documents(emails, attachments, cfg)
    rows = documents.select("thread_id", F.posexplode(chunk_text(F.col("text"), cfg.chunk_size, cfg.separators)).alias("n", "text"))
    return sorted(tuple(r) for r in rows.collect())


def current(store):
    return sorted(tuple(r) for r in store.chunks().collect())


def run(spark, path, batches, attached=()):
    """Updates batch by batch, compared with a rebuild after each."""
    store, rows, extra = ThreadChunks(spark, str(path), CFG), [], []
    for number, new in enumerate(batches):
        rows += new
        extra += [a for a in attached if a[1] in {m[0] for m in new}]
        emails, attachments = table(spark, rows), files(spark, extra)
        store.update(number, table(spark, new).select("thread_id", "id"), emails, attachments)
        assert current(store) == rebuilt(emails, attachments), number
    return store


def test_late_mails_at_the_end_and_in_the_middle(spark, tmp_path):
    rng = random.Random(1)
    mails = [mail(f"t{t}", n, body(rng, rng.randint(0, 120)), f"t{t}-{n - 1}" if n else None) for t in range(6) for n in range(14)]
    attached = [(f"f{i}", m[0], f"{i}.txt", "text/plain", ".txt", 5, body(rng, 60)) for i, m in enumerate(mails) if i % 5 == 0]
    late = [m for m in mails if m[0] in ("t0-13", "t1-12", "t2-0", "t3-7", "t4-5", "t4-13")]
    later = [m for m in mails if m[0] in ("t3-11", "t5-13", "t0-12")]
    first = [m for m in mails if m not in late and m not in later]
    later, late = [*later, mail("t9", 1, ""), mail("t9", 2, body(rng, 300))], [*late, mail("t9", 0, "short")]
    store = run(spark, tmp_path, [first, late, later], attached)
    cuts = {(r["thread_id"], r["batch"]): r["from_chunk"] for r in store._committed("cuts").collect()}
    # The replies at the end leave most of the thread as it was.
    assert cuts["t5", 2] > 5 and cuts["t4", 1] > 0 and cuts["t2", 1] == 0


def test_a_parent_that_arrives_after_its_reply(spark, tmp_path):
    rng = random.Random(2)
    text = body(rng, 80)
    mails = [mail("t", n, body(rng, 70)) for n in range(9)]
    parent = mail("t", 20, text, day=30)
    reply = mail("t", 21, f"My answer\n\nOn Mon, someone wrote:\n{text}", "t-20", day=10)
    run(spark, tmp_path, [mails, [reply, mail("t", 22, body(rng, 50), day=11)], [parent]])


def test_marks_in_a_mail_and_empty_threads(spark, tmp_path):
    rng = random.Random(3)
    quoted = f"before{END_EMAIL}\n\nafter ===== Begin Email Thread ===== {body(rng, 90)} ===== End Email Thread ===== rest"
    first = [mail("t", n, quoted if n == 2 else body(rng, 60)) for n in range(6)] + [mail("u", n, body(rng, 60)) for n in range(6)] + [mail("e", 0, " ")]
    run(spark, tmp_path, [first, [mail("t", 7, body(rng, 40)), mail("u", 7, quoted), mail("e", 1, "")], [mail("u", 8, "end"), mail("e", 2, "text")]])


def test_lengths_at_the_limit(spark, tmp_path):
    """Threads of every length around one chunk, two chunks, and a pack that just fits."""
    run(spark, tmp_path, [[m for size in range(20, 360, 7) for m in (mail(f"s{size}", 0, "a" * size), mail(f"s{size}", 1, "b" * (size // 2)))]])


def test_a_batch_counts_once(spark, tmp_path):
    rng = random.Random(4)
    first, second = [mail("t", n, body(rng, 60)) for n in range(8)], [mail("t", 9, body(rng, 30))]
    store = ThreadChunks(spark, str(tmp_path), CFG)
    store.update(0, table(spark, first).select("thread_id", "id"), table(spark, first))
    before = current(store)
    # A batch that failed before its commit leaves nothing to be seen, and is run again.
    real, store._write = store._write, lambda rows, part, batch: (_ for _ in ()).throw(RuntimeError) if part == "commits" else real(rows, part, batch)
    with pytest.raises(RuntimeError):
        store.update(1, table(spark, second).select("thread_id", "id"), table(spark, first + second))
    assert current(store) == before
    store._write = real
    for _ in range(2):
        store.update(1, table(spark, second).select("thread_id", "id"), table(spark, first + second))
    assert current(store) == rebuilt(table(spark, first + second), None)


def test_threads_in_segments_have_the_same_chunks(spark, tmp_path):
    rng = random.Random(5)
    mails = [mail("t", n, body(rng, 90), f"t-{n - 1}" if n else None) for n in range(60)]
    cfg = MailConfig(chunk_size=400, heavy_chars=3000, heavy_rows=20)
    store = ThreadChunks(spark, str(tmp_path), cfg)
    store.update(0, table(spark, mails[:58]).select("thread_id", "id"), table(spark, mails[:58]))
    store.update(1, table(spark, mails[58:]).select("thread_id", "id"), table(spark, mails))
    assert current(store) == rebuilt(table(spark, mails), None)


def test_quotes_are_stripped_once_per_update(spark, tmp_path, monkeypatch):
    from mailspark.plans import resume

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    keep = resume.strip_quotes
    monkeypatch.setattr(resume, "strip_quotes", lambda mails, cfg: keep(mails, cfg).withColumn("text", counted("text")))
    rng = random.Random(9)
    rows = [mail(f"t{t}", n, body(rng, 60), f"t{t}-{n - 1}" if n else None) for t in range(3) for n in range(4)]
    emails = table(spark, rows)
    store = ThreadChunks(spark, str(tmp_path / "chunks"), CFG)
    store.update(0, emails.select("thread_id", "id"), emails)
    assert current(store) == rebuilt(emails, None)
    assert seen.value == len(rows)
