"""Thread operators: light and heavy paths, quotes, positions."""

import difflib
import random
import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mailspark.config import QUOTE_PATTERNS, MailConfig
from mailspark.operators import skew, threads
from mailspark.operators.quotes import quote_split, strip_quotes
from mailspark.schemas import ATTACHMENTS, EMAILS
from mailspark.sources import fixtures

T0 = datetime(2024, 1, 1)


def email(id, thread="t", minutes=0, body="body", parent=None, subject="s", embedded=False, micros=0):
    return (id, thread, subject, [], parent, T0 + timedelta(minutes=minutes, microseconds=micros), "a@x", ["b@x"], body, embedded)


def attachment(id, email_id, filename, text):
    return (id, email_id, filename, "text/plain", None, 1, text)


def frames(spark, emails, attachments=()):
    return spark.createDataFrame(emails, EMAILS), spark.createDataFrame(list(attachments), ATTACHMENTS)


def random_mail(seed, n_threads=12):
    rng = random.Random(seed)
    words = "alpha beta gamma delta on wrote: To: me Subject: it\nline http://x.y/z www.a.b".split(" ")
    emails, files = [], []
    for t in range(n_threads):
        made = []
        for k in range(rng.randrange(1, 7)):
            body = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))
            parent = rng.choice(made) if made and rng.random() < 0.8 else None
            if parent and rng.random() < 0.8:
                quoted = parent[8]
                if rng.random() < 0.5:
                    quoted = "\n".join("> " + line for line in quoted.split("\n"))
                mark = rng.choice(["On Monday, x wrote:", "----- Original Message -----", "From: someone", "--- Forwarded message ---"])
                body = f"{body}\n{mark}\n{quoted}"
            if rng.random() < 0.15:
                body = "  \n "
            made.append(email(f"{t}-{k}", f"t{t}", rng.randrange(0, 50), body, parent[0] if parent else rng.choice([None, "missing"]),
                              rng.choice([" sub ", "", "x"]), micros=rng.choice([0, 5])))
            for f in range(rng.randrange(0, 3)):
                files.append(attachment(f"f{t}-{k}-{f}", f"{t}-{k}", f"n{rng.randrange(2)}.txt", rng.choice([None, "", " text ftp://q ", "more\n"])))
        emails += made
    return emails, files


WRITTEN_MAILS = [
    email("a", "t1", 5, "  First body.\n", subject=" Plans "),
    email("b", "t1", 9, "I agree.\n\nOn Mon, someone wrote:\nFirst body.", "a", "Re: Plans"),
    email("c", "t1", 7, "Look at https://x.example/a?b and www.y.example now\nFrom: nobody in particular", "a", "Re: Plans"),
    email("d", "t1", 11, " \n ", "b"),
    email("e", "t2", 0, "A question\n----- Original Message -----\nwith its own quote", "gone", ""),
    email("f", "t2", 1, "Answer\n---- Forwarded message ----\nA question\n----- Original Message -----\nwith its own quote!", "e", "x", micros=5),
    email("g", "t3", 0, "  "),
]
WRITTEN_FILES = [
    attachment("1", "b", "z.txt", " late file "), attachment("2", "b", "a.txt", "early file"), attachment("3", "a", "n.txt", None),
    attachment("4", "d", "lost.txt", "of an empty email"), attachment("5", "e", "q.txt", "ftp://host/path kept"),
]
# Written down by hand from the layout.
WRITTEN_DOCUMENTS = {
    "t1": """===== Begin Email Thread =====

Subject: Plans

--- Email 1 ---
Date: 2024-01-01 00:05:00

First body.
--- End Email ---

--- Email 2 ---
Date: 2024-01-01 00:07:00

Look at  and  now
From: nobody in particular
--- End Email ---

--- Email 3 ---
Date: 2024-01-01 00:09:00

I agree.

--- Begin Attachment: a.txt (None) ---
early file
--- End Attachment ---

--- Begin Attachment: z.txt (None) ---
late file
--- End Attachment ---
--- End Email ---

===== End Email Thread =====""",
    "t2": """===== Begin Email Thread =====

Subject: (no subject)

--- Email 1 ---
Date: 2024-01-01 00:00:00

A question
----- Original Message -----
with its own quote

--- Begin Attachment: q.txt (None) ---
 kept
--- End Attachment ---
--- End Email ---

--- Email 2 ---
Date: 2024-01-01 00:01:00.000005

Answer
--- End Email ---

===== End Email Thread =====""",
}
LAYOUTS = [MailConfig(), MailConfig(heavy_chars=60), MailConfig(heavy_chars=1), MailConfig(heavy_rows=2), MailConfig(heavy_chars=60, small_keys=0)]


def joined(rows):
    got = {}
    for row in sorted(rows, key=lambda r: (r.thread_id, r.segment)):
        got[row.thread_id] = got.get(row.thread_id, "") + row.text
    return got


@pytest.mark.parametrize("cfg", LAYOUTS)
def test_documents_as_written_by_hand(spark, cfg):
    assert joined(threads.thread_documents(*frames(spark, WRITTEN_MAILS, WRITTEN_FILES), cfg).collect()) == WRITTEN_DOCUMENTS


@pytest.mark.parametrize("cfg", LAYOUTS[1:])
def test_segments_add_up_to_the_document(spark, cfg):
    emails, files = random_mail(7)
    whole = threads.thread_documents(*frames(spark, emails, files)).collect()
    assert {r.segment for r in whole} == {0}
    assert joined(threads.thread_documents(*frames(spark, emails, files), cfg).collect()) == joined(whole)
    mail, _ = frames(spark, emails)
    assert joined(threads.thread_documents(mail, None, cfg).collect()) == joined(threads.thread_documents(mail).collect())


def test_one_thread_holds_most_rows(spark):
    emails = [email(f"h{i:04d}", "hot", i, f"text {i}", f"h{i - 1:04d}") for i in range(600)]
    emails += [email(f"c{i}", f"c{i}", 0, "cold") for i in range(50)]
    mail, _ = frames(spark, emails)
    rows = threads.thread_documents(mail, None, MailConfig(heavy_chars=500)).collect()
    hot = [r for r in rows if r.thread_id == "hot"]
    assert len(hot) > 5 and max(len(r.text) for r in hot) < 10_000
    text = joined(rows)["hot"]
    assert [f"--- Email {i + 1} ---\nDate: {T0 + timedelta(minutes=i)}\n\ntext {i}\n--- End Email ---" in text for i in range(600)] == [True] * 600
    assert text.count("--- Email ") == 600 and len({r.thread_id for r in rows}) == 51


@pytest.mark.parametrize("heavy_rows", [1_000_000, 3])
def test_positions(spark, heavy_rows):
    emails, _ = random_mail(9)
    mail, _ = frames(spark, emails)
    got = {r.id: r.position for r in threads.email_positions(mail, MailConfig(heavy_rows=heavy_rows)).collect()}
    for thread in {e[1] for e in emails}:
        ordered = sorted((e for e in emails if e[1] == thread), key=lambda e: (e[5], e[0]))
        assert [got[e[0]] for e in ordered] == list(range(1, len(ordered) + 1))
    assert len(got) == len(emails)


def test_running_sums_with_null_key(spark):
    rows = [(None if i % 3 else f"k{i % 2}", i, i % 5) for i in range(300)]
    frame = spark.createDataFrame(rows, "k string, o int, w int")
    for heavy in (10, 1000):
        got = skew.running_sums(frame, "k", ["o"], {"s": F.col("w")}, heavy, 100).collect()
        totals, expected = {}, {}
        for k, o, w in sorted(rows, key=lambda r: r[1]):
            totals[k] = totals.get(k, 0) + w
            expected[(k, o)] = totals[k]
        assert {(r.k, r.o): r.s for r in got} == expected


def test_quote_split_prefers_list_order(spark):
    bodies = ["a\nSubject: x\nb On day y wrote: c", "x to: y\nz FROM: q\nw", "nothing here", "---- Forwarded message ----\ntail", "On a\nwrote: b"]
    got = spark.createDataFrame([(b,) for b in bodies], "b string").select(quote_split(F.col("b"))).collect()
    for body, (pair,) in zip(bodies, got):
        found = next((m for p in QUOTE_PATTERNS if (m := re.search(p, body, re.IGNORECASE))), None)
        assert pair == (None if not found else [body[:found.start()], body[found.end():]])


def test_quote_split_on_long_lines(spark):
    """A line with many possible starts and no end, and a long run of dashes."""
    line = "on and on " * 100_000
    bodies = [line, line + "wrote: tail", "wrote: " + line, "-" * 300_000, "-" * 300_000 + " Original Message ----x", "a\n" + line + "\nOn day x wrote: c\nd"]
    start = time.perf_counter()
    got = [r[0] for r in spark.createDataFrame([(b,) for b in bodies], "b string").coalesce(1).select(quote_split(F.col("b"))).collect()]
    assert time.perf_counter() - start < 30
    assert got == [None, ["", " tail"], None, None, ["", "x"], ["a\n" + line + "\n", " c\nd"]]


def test_near_copies_are_quotes(spark):
    """The diff decides: a copy with one word in fifty replaced, and one with half."""
    words = [f"word{i}" for i in range(50)]
    near, far = [*words[:25], "other", *words[26:]], [w if i % 2 else "qqzz" for i, w in enumerate(words)]
    mails = [email("p", body=" ".join(words)), email("n", minutes=1, body=f"near\nOn day x wrote:\n{' '.join(near)}", parent="p"),
             email("f", minutes=2, body=f"far\nOn day x wrote:\n{' '.join(far)}", parent="p")]
    got = {r.id: r.text for r in strip_quotes(frames(spark, mails)[0], MailConfig(autojunk=False)).collect()}
    assert got["n"] == "near" and got["f"].startswith("far\nOn day x")


def test_autojunk_and_prefix_options(spark):
    parent = "a longer parent body with enough of its own words to matter, line one\n" * 5
    quoted = "\n".join("> " + line for line in parent.strip().split("\n"))
    mail, _ = frames(spark, [email("p", minutes=0, body=parent), email("r", minutes=1, body=f"reply\nOn day x wrote:\n{quoted}", parent="p")])
    ratio = difflib.SequenceMatcher(None, quoted, parent.strip()).ratio()
    got = {r.id: r.text for r in strip_quotes(mail, MailConfig()).collect()}
    assert (got["r"] == "reply") == (ratio >= 0.8)
    lenient = {r.id: r.text for r in strip_quotes(mail, MailConfig(strip_quote_prefix=True, autojunk=False)).collect()}
    assert lenient["r"] == "reply"


def test_pending_ignores_null(spark):
    mail, _ = frames(spark, [email("a", "x", embedded=None), email("b", "y", embedded=True), email("c", "z", embedded=False)])
    assert [r.thread_id for r in threads.pending_threads(mail).collect()] == ["z"]
    assert [r.id for r in threads.rebuild_scope(mail, MailConfig()).collect()] == ["c"]
    assert [r.id for r in threads.rebuild_scope(mail, MailConfig(small_keys=0)).collect()] == ["c"]


def test_light_plan_has_one_wide_exchange(spark, sf):
    plan = threads._whole_documents(fixtures.emails(spark, sf), None, MailConfig())._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning(thread_id") == 1
