"""Text expressions against the Python behaviour they stand for."""

import os
import random
import re
from email.utils import parsedate_to_datetime
from datetime import timezone

import pytest
from pyspark.sql import functions as F

from mailspark.functions import dates, mime, text

ALPHABET = list("ab.:/ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  ‍­　>") + [
    "http://", "https://x", "www.", "ftp://", "\n\n", "é", "😀"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def evaluate(spark, values, *expressions):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in frame.select("i", *expressions).orderBy("i").collect()]


def test_against_python(spark):
    texts = random_texts(800, 1)
    got = evaluate(
        spark, texts, text.strip(F.col("v")).alias("a"), text.remove_links(F.col("v")).alias("b"),
        text.normalize_text(F.col("v")).alias("c"), text.split_references(F.col("v")).alias("d"),
        text.indent_block(F.col("v")).alias("e"),
    )
    for value, (stripped, unlinked, normal, refs, indented) in zip(texts, got):
        assert stripped == value.strip()
        assert unlinked == re.sub(r"https?://\S+|www\.\S+|ftp://\S+", "", value)
        expected = re.sub("[‌‍‎‏‪-‮⁠-⁯­\xa0]", " ", value)
        expected = re.sub(r"\n\s*\n+", "\n\n", re.sub(r"[ \t]+", " ", expected)).strip()
        assert normal == expected
        assert refs == value.split()
        lines = value.strip().splitlines()
        assert indented == "\n".join(" " * 9 + line if line.strip() else "" for line in lines)


def test_file_extension(spark):
    names = ["a.TXT", "a.tar.gz", ".bashrc", "x.", "dir.d/name", "dir/.hidden.txt", "", "..a", "a..b", "..a.b", "a b.c d", "a.b\n"]
    got = evaluate(spark, names, text.file_extension(F.col("v")).alias("e"))
    assert [e for (e,) in got] == [os.path.splitext(n)[-1].lower() for n in names]


def test_datetime_text(spark):
    rows = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:07.5' a, TIMESTAMP_NTZ '2024-03-31 02:30:00' b, CAST(NULL AS TIMESTAMP_NTZ) c")
    got = rows.select(*[text.datetime_text(F.col(c)) for c in "abc"]).first()
    assert tuple(got) == ("2024-01-01 00:00:07.500000", "2024-03-31 02:30:00", None)


def test_choose_body(spark):
    frame = spark.createDataFrame([("<b>", "p"), ("", " p\0 "), (None, "p"), (None, None), ("", "")], "h string, p string")
    got = [r[0] for r in frame.select(text.choose_body(F.col("h"), F.col("p"))).collect()]
    assert got == ["<b>", "p", "p", "", ""]


@pytest.mark.parametrize("header", [
    "Mon, 01 Jan 2024 10:00:00 +0200", "1 Feb 2024 10:00:00 GMT", "Tue, 2 Jan 2024 03:04:05 EST",
    "2 Jan 2024 03:04 -0000", "Tue, 2 Jan 24 03:04:05 -0330", "Tue, 2 Jan 2024 03:04:05 +0530 (IST)",
    "Fri, 2 Jan 70 03:04:05 PDT", "29 Feb 2024 23:59:59 +0000", "Tue, 02 January 2024 03:04:05 +0100",
])
def test_dates(spark, header):
    moment = parsedate_to_datetime(header)
    if moment.tzinfo:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    (got,), = evaluate(spark, [header], dates.parse_mail_date(F.col("v")).alias("d"))
    assert got == moment


def test_unreadable_dates(spark):
    values = ["", None, "tomorrow", "31 Feb 2024 10:00:00 +0000", "2024-01-01", "1 Foo 2024 10:00:00 +0000", "1 Jan 2024 25:00:00 +0000"]
    assert all(d is None for (d,) in evaluate(spark, values, dates.parse_mail_date(F.col("v")).alias("d")))


def test_mime(spark):
    cases = [
        (b"%PDF-1.4", "text/plain", "a.txt", "application/pdf"),
        (b"\x89PNG\r\n\x1a\nx", None, "a", "image/png"),
        (b"\xff\xd8\xff\xe0", None, "a", "image/jpeg"),
        (b"PK\x03\x04 zip", None, "a", "application/zip"),
        (b"PK\x03\x04 word/document.xml", None, "a", mime.DOCX),
        (b'{"a": [1, 2]}', "text/plain", "a", "application/json"),
        (b"{not json", "x/y", "a", "text/plain"),
        (b"<!DOCTYPE html><p>", None, "a", "text/html"),
        (b"From: a@x\nSubject: s\n\nhi", None, "a", "message/rfc822"),
        (b"a,b\n1,2\n", None, "a", "text/csv"),
        (b"hello, you", None, "a", "text/plain"),
        (b"\x00\x01\xfe", "x/declared", "a.zip", "x/declared"),
        (b"\x00\x01\xfe", "", "a.ZIP", "application/zip"),
        (b"\x00\x01\xfe", None, "a.unknown", "application/octet-stream"),
        (b"", None, "noext", "application/octet-stream"),
    ]
    frame = spark.createDataFrame([(i, bytearray(c), d, f) for i, (c, d, f, _) in enumerate(cases)], "i int, c binary, d string, f string")
    got = [r[1] for r in frame.select("i", mime.detect_mime(F.col("c"), F.col("d"), F.col("f"))).orderBy("i").collect()]
    assert got == [expected for *_, expected in cases]
