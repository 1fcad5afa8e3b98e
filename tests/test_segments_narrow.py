"""Chunks of segments are numbered, and files weighed, without their texts."""

from pyspark.sql import functions as F

from mailspark.config import SEPARATORS
from mailspark.operators import packing, threads
from mailspark.operators.threads import END_EMAIL, LAYOUT, TAIL


def test_ranges_hold_no_texts(spark, monkeypatch):
    seen, plain = [], packing.sums_by_range
    monkeypatch.setattr(packing, "sums_by_range", lambda df, *rest: seen.append(df.columns) or plain(df, *rest))
    mails = [f"\n\n--- Email {n} ---\n" + f"word{n} " * 60 + END_EMAIL for n in range(12)]
    parts = [LAYOUT.head + "".join(mails[:5]), "".join(mails[5:9]), "".join(mails[9:]) + TAIL]
    rows = [(t, k, p) for t in ("a", None) for k, p in enumerate(parts)]
    got = packing.chunk_segments(spark.createDataFrame(rows, "thread_id string, segment bigint, text string"), 700, SEPARATORS, LAYOUT)
    whole = spark.createDataFrame([("".join(parts),)], "text string").select(packing.chunk_text(F.col("text"), 700).alias("c")).first().c
    found = sorted(((r.thread_id or "", r.chunk_no, r.text) for r in got.collect()))
    assert found == sorted((t, k, c) for t in ("a", "") for k, c in enumerate(whole))
    assert seen and all("text" not in columns for columns in seen)


def test_weights_of_files_leave_the_texts_behind(spark):
    mails = spark.createDataFrame([("m", "t", None)], "id string, thread_id string, date timestamp_ntz")
    files = spark.createDataFrame([("m", "f", "abc")], "email_id string, id string, text_content string")
    owned = threads._owned(files, mails).groupBy("email_id").agg(F.sum("_weight").alias("n"))
    assert owned.first().n == 3 + threads._MARKS
