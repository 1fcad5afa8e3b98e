"""Headers first, ids by bucket, and only new mail parsed."""

import json
from email.header import Header
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from mailspark.operators.id_index import IdIndex
from mailspark.plans.ingest import MailStore
from mailspark.session import entries
from mailspark.sources import mailapi
from mailspark.sources.headers import header_id
from mailspark.sources.mbox import MBOX, parse_mbox, read_mbox
from mailspark.sources.messages import parse_mail

HEADS = [
    "Message-ID: <a@x>\nSubject: s\n\nbody\nMessage-ID: <no@x>\n",
    "Subject: s\r\nmessage-id:\t<b@x>  \r\n\r\nbody",
    "Subject: long\n folded\n\tagain\nMESSAGE-ID:\n <c@x>\nTo: d@e\n\nbody",
    "Message-ID: <first@x>\nMessage-ID: <second@x>\n\n",
    "Message-ID: <d@x>\n more\n\nbody", "Subject: none\n\nMessage-ID: <body@x>", "Message-ID:\n\nbody",
    "no header line\nMessage-ID: <e@x>\n\nbody", "Subject: é\nMessage-ID: <f@x>\n\n", "Subject: a\rMessage-ID: <g@x>\n\n",
    " Message-ID: <h@x>\nMessage-ID: <i@x>\n\n", "Message-ID: <j@x>", "", "X:\nMessage-ID: <k@x>\n\n" + "y" * 100_000,
]


def test_ids_from_headers_are_those_of_the_parser(spark):
    rows = [(i, f"From a@b Mon\n{head}") for i, head in enumerate(HEADS)]
    got = {r["i"]: r["id"] for r in spark.createDataFrame(rows, "i int, raw string").select("i", header_id(F.col("raw")).alias("id")).collect()}
    parsed = {i: parse_mail(raw.encode())["message_id"] for i, raw in rows}
    assert {i: got[i] for i in got if got[i] is not None} == {i: parsed[i] for i in got if got[i] is not None}
    assert [got[i] for i in (0, 1, 2, 3, 11, 13)] == ["<a@x>", "<b@x>", "<c@x>", "<first@x>", "<j@x>", "<k@x>"]
    assert all(got[i] is None for i in (4, 5, 6, 7, 8, 9, 10, 12))


def mail(number, text="text"):
    message = EmailMessage()
    message["Message-ID"] = f"<{number}@x>"
    message["From"], message["To"], message["Subject"] = "a@b", "c@d", f"subject {number}"
    message["Date"] = "Mon, 01 Jan 2024 08:00:00 +0000"
    message.set_content(text)
    return message.as_bytes()


def mbox(path, mails):
    path.write_bytes(b"".join(b"From a@b Mon Jan 1 08:00:00 2024\n" + m.rstrip(b"\n") + b"\n\n" for m in mails))
    return str(path)


def parsed_counts(store):
    return [r["parsed"] for r in store._read("commits").orderBy("writer").collect()]


def test_only_new_mail_is_parsed(spark, tmp_path):
    store = MailStore(spark, str(tmp_path / "store"))
    store.insert_records(read_mbox(spark, mbox(tmp_path / "a", [mail(i) for i in range(40)] + [mail(3, "copy")] * 5)), MBOX, writer="a")
    store.insert_records(read_mbox(spark, mbox(tmp_path / "b", [mail(i) for i in range(30, 50)] + [mail(1)] * 9)), MBOX, writer="b")
    store.insert_records(read_mbox(spark, mbox(tmp_path / "c", [mail(i) for i in range(50)])), MBOX, writer="c")
    odd = b"Subject: =?utf-8?q?caf=C3=A9?=\nbroken line\nMessage-ID: <x@x>\n\nbody"
    store.insert_records(read_mbox(spark, mbox(tmp_path / "d", [mail(2), odd, mail(77)])), MBOX, writer="d")
    assert parsed_counts(store) == [40, 10, 0, 2]
    assert store.emails().count() == 51
    assert store.emails().where("id = '<3@x>'").first()["body"].strip() == "text"


def test_same_store_as_parsing_everything(spark, tmp_path):
    paths = [mbox(tmp_path / f"m{n}", [mail(i % 23, f"{n} {i}") for i in range(n, 60, 3)] + HEADS_BYTES) for n in range(3)]
    one, two = MailStore(spark, str(tmp_path / "one")), MailStore(spark, str(tmp_path / "two"))
    for path in paths:
        one.insert_new(parse_mbox(read_mbox(spark, path)))
        two.insert_records(read_mbox(spark, path), MBOX)
    rows = [sorted(tuple(r) for r in s.emails().select("id", "subject", "body", "thread_id").collect()) for s in (one, two)]
    assert rows[0] == rows[1] and len(rows[0]) > 23


HEADS_BYTES = [head.encode() for head in HEADS if head]


def resource(number, **over):
    headers = [{"name": "Message-ID", "value": f"<{number}@x>"}, {"name": "Subject", "value": "s"}]
    body = {"mimeType": "text/plain", "headers": headers, "body": {"data": "dGV4dA=="}}
    return json.dumps({"id": f"r{number}", "threadId": "t", "labelIds": ["INBOX"], "internalDate": str(1000 + number), "payload": body, **over})


def test_resources_and_a_first_copy_that_cannot_be_read(spark, tmp_path):
    broken = resource(5, internalDate="10", payload={"headers": [{"name": "Message-ID", "value": "<5@x>"}], "parts": "none"})
    (tmp_path / "r").write_text("\n".join([resource(i) for i in range(10)] + [broken, '{"id": 1, "payload": 7}']))
    store = MailStore(spark, str(tmp_path / "store"))
    for writer in ("a", "b"):
        store.insert_records(mailapi.read_resources(spark, str(tmp_path / "r")), mailapi.RESOURCES, writer=writer)
    assert sorted(r["id"] for r in store.emails().collect()) == sorted(f"<{i}@x>" for i in range(10))
    assert parsed_counts(store)[0] == 12 and parsed_counts(store)[1] <= 1
    assert store.mark() == 1009 and store.rejected().where("place LIKE '%10, r5%'").count() == 1


@pytest.fixture
def index(spark, tmp_path):
    return IdIndex(spark, str(tmp_path / "ids"), lambda writer, batch: writer != "failed", buckets=64, fanout=3)


def ids(spark, begin, end):
    return spark.range(begin, end).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("id"))


def test_a_poll_opens_the_buckets_of_its_ids(spark, index):
    index.add(ids(spark, 0, 20_000), "load/1", 0)
    index.add(ids(spark, 90_000, 90_010), "failed", 0)
    asked = ids(spark, 19_998, 20_002)
    assert sorted(r["id"] for r in index.known(asked).collect()) == ["m19998", "m19999"]
    near = index.near(asked)
    assert 0 < near.count() < 20_000 * 6 / 64 and len(near.inputFiles()) <= 4
    assert index.known(ids(spark, 90_000, 90_010)).isEmpty() and index.known(ids(spark, 0, 0)).isEmpty()
    assert index.known(ids(spark, 0, 30_000)).count() == 20_000


def test_runs_are_folded_and_the_covered_ones_go(spark, index):
    for n in range(13):
        index.add(ids(spark, 10 * n, 10 * n + 10), "w", n)
        index.fold()
        assert index.known(ids(spark, 0, 1000)).count() == 10 * n + 10
        assert len(index.runs()) <= 2 * 3
    assert max(index.runs().values()) == 2
    assert len(entries(spark, f"{index.root}/runs")) <= 13
