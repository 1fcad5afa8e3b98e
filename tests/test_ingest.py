"""Mail formats to table rows."""

import base64
import glob
import io
import json
import zipfile
from datetime import datetime
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from mailspark.functions import files, html
from mailspark.functions.mime import DOCX
from mailspark.operators.ingest import attachments_from, emails_from, first_per_key, message_rows
from mailspark.plans.ingest import MailStore
from mailspark.schemas import ATTACHMENTS, EMAILS
from mailspark.session import shared_dir
from mailspark.sources import mailapi
from mailspark.sources.mbox import parse_mbox, read_mbox

PREAMBLE = b"Message-ID: <preamble@x>\nSubject: dropped\n\nnot a message\n"


def mbox_bytes(*messages):
    return b"".join(b"From a@x Mon Jan  1 00:00:00 2024\n" + m + b"\n" for m in messages)


def message(message_id="<1@x>", body=b"hello", **headers):
    lines = [f"Message-ID: {message_id}"] if message_id else []
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items()]
    return "\n".join(lines).encode() + b"\n\n" + body + b"\n"


def ingest(spark, tmp_path, data, name="a.mbox", **options):
    path = tmp_path / name
    path.write_bytes(data)
    return message_rows(parse_mbox(read_mbox(spark, str(path), **options)))


def by_id(frame):
    return {r.id: r for r in frame.collect()}


def test_mbox_records(spark, tmp_path):
    data = PREAMBLE + mbox_bytes(
        message("<1@x>", b"first"), message(None, b"no id"), message("<1@x>", b"copy"),
        message("<2@x>", b"a\n>From b\nlast\nFrom here on it is another message"),
        message("<3@x>", "Gr\xfc\xdfe".encode("latin-1"), Content_Type="text/plain; charset=iso-8859-1"),
    )
    got = by_id(emails_from(ingest(spark, tmp_path, data)))
    assert set(got) == {"<1@x>", "<2@x>", "<3@x>"}
    assert got["<1@x>"].body == "first"
    assert got["<2@x>"].body == "a\n>From b\nlast"
    assert got["<3@x>"].body == "Gr\xfc\xdfe"


def test_mbox_without_separator_is_one_message(spark, tmp_path):
    assert set(by_id(emails_from(ingest(spark, tmp_path, message("<only@x>", b"x"))))) == {"<only@x>"}


def test_mbox_is_split(spark, tmp_path):
    many = [message(f"<{i}@x>", b"body %d " % i * 50) for i in range(400)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.mbox").write_bytes(PREAMBLE + mbox_bytes(*many))
    (tmp_path / "m" / "b.mbox").write_bytes(mbox_bytes(*[message(f"<{i}@x>", b"second") for i in range(450)]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        records = read_mbox(spark, str(tmp_path / "m"))
        assert records.rdd.getNumPartitions() > 4
        got = by_id(emails_from(message_rows(parse_mbox(records))))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(got) == {f"<{i}@x>" for i in range(450)}
    # The file read first wins where both have an id.
    assert all((got[f"<{i}@x>"].body == "second") == (i >= 400) for i in range(450))


def test_records_know_their_place(spark, tmp_path):
    """Neither a shuffle nor a filter changes which records are a file's first."""
    for f in range(4):
        (tmp_path / f"{f}.mbox").write_bytes((PREAMBLE if f % 2 else b"") + mbox_bytes(*[message(f"<{f}-{i}@x>") for i in range(25)]))
    records = read_mbox(spark, str(tmp_path))
    want = {f"<{f}-{i}@x>" for f in range(4) for i in range(25)}
    for changed in (records, records.repartition(6), records.where("value not like '%<0-3@x>%'"), records.orderBy(F.desc("row"))):
        got = {r.message_id for r in parse_mbox(changed).collect()}
        assert want - got <= {"<0-3@x>"} and got <= want
    assert len(parse_mbox(records.repartition(6)).collect()) == 100


def test_rejected_messages_and_hooks(spark, tmp_path):
    store = MailStore(spark, str(tmp_path / "store"))
    frame = parse_mbox(read_mbox(spark, _file(tmp_path, mbox_bytes(message("<1@x>"), message("<2@x>")))))
    broken = frame.withColumn("error", F.when(F.col("message_id") == "<2@x>", "ValueError: bad"))
    store.insert_new(broken)
    assert [r.id for r in store.emails().collect()] == ["<1@x>"]
    assert [r.error for r in store.rejected().collect()] == ["ValueError: bad"]
    mail = EmailMessage()
    mail["Message-ID"] = "<pdf@x>"
    mail.set_content("text")
    mail.add_attachment(b"%PDF-1.4", maintype="application", subtype="pdf", filename="a.pdf")
    store.insert_new(parse_mbox(read_mbox(spark, _file(tmp_path, mbox_bytes(mail.as_bytes()), "b.mbox"))), extra={"application/pdf": lambda data: "read"})
    assert [r.text_content for r in store.attachments().collect()] == ["read"]


def _file(folder, data, name="a.mbox"):
    (folder / name).write_bytes(data)
    return str(folder / name)


def test_limit_counts_before_filtering(spark, tmp_path):
    data = mbox_bytes(message(None, b"no id"), message("<1@x>"), message("<2@x>"))
    assert set(by_id(emails_from(ingest(spark, tmp_path, data, limit=2)))) == {"<1@x>"}


def test_the_first_records_of_many_blocks(spark, tmp_path):
    """Any limit takes the records a sort by place would, out of files with several
    blocks, without messages, and with names that are patterns."""
    folder = tmp_path / "in [a] b{1}*"
    folder.mkdir()
    for name, number in [("a?.mbox", 7), ("b c.mbox", 0), ("c%20.mbox", 40), ("d.mbox", 3)]:
        (folder / name).write_bytes(mbox_bytes(*(message(f"<{name[0]}{i}@x>", b"x" * 300) for i in range(number))))
    path = str(tmp_path / "in*")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        place = ["path", "block", "row", "is_first", "value"]
        every = [tuple(r) for r in read_mbox(spark, path).select(*place).orderBy("path", "block", "row").collect()]
        assert len({r[:2] for r in every}) > 8
        for limit in (0, 7, 20, len(every) - 1, len(every) + 5):
            first = read_mbox(spark, path, limit=limit)
            values = sorted((r["path"], bytes(r["value"])) for r in first.collect())
            assert values == sorted((r[0], bytes(r[4])) for r in every[:limit])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_a_limit_reads_the_files_it_needs(spark, tmp_path):
    for i in range(9):
        _file(tmp_path, mbox_bytes(message(f"<{i}a@x>"), message(f"<{i}b@x>")), f"{i}.mbox")
    assert len(read_mbox(spark, str(tmp_path), limit=2).inputFiles()) == 1
    assert len(read_mbox(spark, str(tmp_path), limit=5).inputFiles()) == 4


def test_headers(spark, tmp_path):
    data = mbox_bytes(
        message("<1@x>", Subject="=?utf-8?q?Gr=C3=BC=C3=9Fe?= you", From="=?utf-8?b?w4Q=?= <a@x>",
                To="B <b@x>, c@x\nTo: d@x", References="<r1@x>\n\t<r2@x>", In_Reply_To="<r2@x>",
                Date="Mon, 01 Jan 2024 10:00:00 +0200"),
        message("<2@x>", Subject="=?nocharset?q?a?=", In_Reply_To="<1@x>", Date="never"),
        message("<3@x>", References="   "),
    )
    now = F.lit(datetime(2030, 1, 1)).cast("timestamp_ntz")
    got = by_id(emails_from(ingest(spark, tmp_path, data), now))
    first = got["<1@x>"]
    assert (first.subject, first.sender, first.recipients) == ("Grüße you", "Ä <a@x>", ["b@x", "c@x", "d@x"])
    assert (first.references, first.thread_id, first.in_reply_to) == (["<r1@x>", "<r2@x>"], "<r1@x>", "<r2@x>")
    assert first.date == datetime(2024, 1, 1, 8)
    assert got["<2@x>"].subject == "=?nocharset?q?a?="
    assert (got["<2@x>"].thread_id, got["<2@x>"].date) == ("<1@x>", datetime(2030, 1, 1))
    assert (got["<3@x>"].thread_id, got["<3@x>"].references) == ("<3@x>", [])


def mime_mail():
    mail = EmailMessage()
    mail["Message-ID"] = "<mime@x>"
    mail["Subject"] = "parts"
    mail.set_content("plain\0 text")
    mail.add_alternative("<p>rich <b>text</b></p>", subtype="html")
    mail.add_attachment(b"one", maintype="text", subtype="plain", filename="a.TXT")
    mail.add_attachment(b"two\xff", maintype="text", subtype="plain", filename="a.TXT")
    inner = EmailMessage()
    inner["From"], inner["To"], inner["Subject"] = "i@x", "j@x", "inner"
    inner.set_content("inner body")
    mail.add_attachment(inner, filename="fwd.eml")
    return mail.as_bytes().replace(b"Content-Disposition: attachment", b"Content-Disposition: ATTACHMENT", 1)


def test_parts(spark, tmp_path):
    rows = ingest(spark, tmp_path, mbox_bytes(mime_mail(), message("<html@x>", b"<p>only</p>", Content_Type="text/html")))
    got = by_id(emails_from(rows))
    assert got["<mime@x>"].body == "rich text"
    assert got["<html@x>"].body == "only"
    files_ = {r.filename: r for r in attachments_from(rows).collect()}
    assert set(files_) == {"a.TXT", "fwd.eml"}
    assert (files_["a.TXT"].text_content, files_["a.TXT"].size, files_["a.TXT"].extension) == ("two", 4, ".txt")
    assert files_["fwd.eml"].mime_type == "message/rfc822"
    assert files_["fwd.eml"].text_content == "From: i@x\nTo: j@x\nSubject: inner\n\ninner body"
    assert len({r.id for r in files_.values()}) == 2


def resource(id, thread, label="INBOX", when=1000, headers=(), payload=None):
    body = {"mimeType": "text/plain", "body": {"data": encoded("hi?>")}}
    return json.dumps({"id": id, "threadId": thread, "labelIds": [label], "internalDate": str(when),
                       "payload": {**(payload or body), "headers": [{"name": n, "value": v} for n, v in headers]}})


def encoded(text):
    data = text if isinstance(text, bytes) else text.encode()
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def test_mail_api(spark, tmp_path):
    nested = {"mimeType": "multipart/mixed", "parts": [
        {"mimeType": "multipart/alternative", "parts": [
            {"mimeType": "text/plain", "body": {"data": encoded("plain")}},
            {"mimeType": "text/html", "body": {"data": encoded("<p>rich</p>")}}]},
        {"mimeType": "text/plain", "filename": "n.txt", "body": {"attachmentId": "1", "data": encoded("note")}},
        {"mimeType": "text/plain", "filename": "n.txt", "body": {"attachmentId": "2", "data": encoded("newer")}}]}
    lines = [
        resource("g1", "t1", headers=[("Message-ID", "<1@x>"), ("To", "a@x"), ("TO", "b@x, C <c@x>")]),
        resource("g2", "t1", when=2000, headers=[("message-id", "<2@x>"), ("Date", "Mon, 01 Jan 2024 10:00:00 +0200")], payload=nested),
        resource("g3", "t2", when=3000, headers=[("Subject", "no id")]),
        resource("g4", "t3", label="SENT", when=4000, headers=[("Message-ID", "<4@x>")]),
        resource("g5", "t4", when=500, headers=[("Message-ID", "<5@x>")]),
        "{broken",
    ]
    (tmp_path / "gmail.jsonl").write_text("\n".join(lines))
    found = mailapi.read_resources(spark, str(tmp_path / "gmail.jsonl"))
    assert {r.resource_id for r in mailapi.inbox(found, 500).collect()} == {"g1", "g2", "g3"}
    assert {r.resource_id for r in mailapi.inbox(found, newest=2).collect()} == {"g2", "g3"}
    store = MailStore(spark, str(tmp_path / "store"))
    assert store.mark() is None
    store.insert_new(mailapi.parse_resources(mailapi.inbox(found, newest=2)))
    assert store.mark() == 3000 and mailapi.inbox(found, store.mark()).count() == 0
    rows = message_rows(mailapi.parse_resources(mailapi.inbox(found)))
    got = by_id(emails_from(rows))
    assert len(got) == 4 and got["<1@x>"].recipients == ["b@x", "c@x"] and got["<1@x>"].body == "hi?>"
    assert got["<2@x>"].body == "rich" and got["<2@x>"].date == datetime(2024, 1, 1, 8)
    (unnamed,) = [i for i in got if not i.startswith("<")]
    assert len(unnamed) == 64 and got[unnamed].thread_id == "t2"
    assert [(r.filename, r.text_content) for r in attachments_from(rows).collect()] == [("n.txt", "newer")]


def docx_bytes():
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f"<w:document {space}><w:body><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>"
    return zip_bytes({"word/document.xml": xml.encode()})


def zip_bytes(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in members.items():
            archive.writestr(name, data)
    return out.getvalue()


def test_attachment_texts(spark):
    cases = [
        ("text/plain", b"a\xffb\0c", "abc"),
        ("text/csv", b"a,b", "a,b"),
        ("application/json", b'{"k": [1]}', '{\n  "k": [\n    1\n  ]\n}'),
        ("application/json", b"{bad", ""),
        ("text/html", b"<p>x</p><p>y</p>", "x\n\ny"),
        (DOCX, docx_bytes(), "one\ttwo\n\nthree"),
        ("application/zip", zip_bytes({"a.TXT": b"A", "b.png": b"no", "d/c.yaml": b"k: v\xff"}), "===== a.TXT =====\nA\n\n===== d/c.yaml =====\nk: v".replace("a.TXT", "a.TXT")),
        ("application/zip", b"broken", ""),
        ("application/pdf", b"%PDF", ""),
        (None, b"x", ""),
    ]
    frame = spark.createDataFrame([(i, m, bytearray(c)) for i, (m, c, _) in enumerate(cases)], "i int, m string, c binary")
    got = [r[1] for r in frame.select("i", F.coalesce(files.attachment_text(F.col("m"), F.col("c")), F.lit(""))).orderBy("i").collect()]
    assert got == [expected for *_, expected in cases]
    locked = bytearray(zip_bytes({"a.txt": b"A" * 50, "b.txt": b"B"}))
    at = locked.index(b"A" * 50)
    locked[at:at + 1] = b"X"  # the checksum no longer fits
    frame2 = spark.createDataFrame([("application/zip", locked), ("application/zip", None), ("application/zip", bytearray(zip_bytes({})))], "m string, c binary")
    read = [r[0] for r in frame2.select(files.attachment_text(F.col("m"), F.col("c"))).collect()]
    assert read == ["===== a.txt =====\n[Could not read file: Bad CRC-32 for file 'a.txt']\n\n===== b.txt =====\nB", "", ""]
    extra = {"application/pdf": lambda data: "pdf of %d bytes" % len(data)}
    got = frame.where("m = 'application/pdf'").select(files.attachment_text(F.col("m"), F.col("c"), extra)).collect()
    assert got[0][0] == "pdf of 4 bytes"


@pytest.mark.parametrize("page, expected", [
    ("<p>a&nbsp;b</p>\n<p>c</p>", "a b\n\nc"),
    ("<head><title>t</title></head>x", "x"),
    ("<html><head><title>t</title><body>seen</body>", "seen"),
    ("a<br>b<br/>c", "a\nb\nc"),
    ("<ul><li>one<li>two</ul>", "* one\n* two"),
    ("<script>x<y</script>text", "text"),
    ("<a href='http://x'>link</a> <img src=x> <b>bold</b>", "link bold"),
    ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "a b\nc"),
    ("<pre>a\n  b</pre>", "a\nb"),
    ("<h2>T</h2>x", "## T\n\nx"),
    ("", ""),
    ("<html><head><title>cut off", ""),
])
def test_html(spark, page, expected):
    got = spark.createDataFrame([(page,)], "p string").select(html.html_to_text(F.col("p"))).first()[0]
    assert got == expected


def test_first_per_key_with_many_copies(spark):
    frame = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), (F.col("id") * 2).alias("v"))
    assert {(r.k, r.o, r.v) for r in first_per_key(frame, ["k"], "o").collect()} == {(0, 0, 0), (1, 1, 2), (2, 2, 4)}


def test_store(spark, tmp_path):
    store = MailStore(spark, str(tmp_path / "store"))
    assert store.emails().count() == 0 and store.attachments().count() == 0
    one = mbox_bytes(message("<1@x>", b"v1"), mime_mail())
    (tmp_path / "1.mbox").write_bytes(one)
    parsed = parse_mbox(read_mbox(spark, str(tmp_path / "1.mbox")))
    store.insert_new(parsed)
    store.insert_new(parsed)
    (tmp_path / "2.mbox").write_bytes(mbox_bytes(message("<1@x>", b"v2"), message("<2@x>", b"new")))
    store.insert_new(parse_mbox(read_mbox(spark, str(tmp_path / "2.mbox"))))
    got = by_id(store.emails())
    assert {i: r.body for i, r in got.items()} == {"<1@x>": "v1", "<mime@x>": "rich text", "<2@x>": "new"}
    assert store.emails().count() == 3 and store.attachments().count() == 2
    # Scratch tables of a load are gone.
    assert not glob.glob(f"{shared_dir(spark)}/scratch/run-*")
    assert store.emails().columns == EMAILS.names and store.attachments().columns == ATTACHMENTS.names
