"""Chunking, summaries, embeddings, search, statistics and dumps."""

import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailspark.config import PLAIN_SEPARATORS, SEPARATORS, MailConfig
from mailspark.operators import chunking, dump, embedding, packing, search, stats, summarize
from mailspark.sources import models


def split_reference(text, size, separators):
    """The same splitting written as a plain recursion."""
    if len(text) <= size or not separators:
        return [text]
    first, rest = separators[0], separators[1:]
    if first == "":
        return [text[i:i + size] for i in range(0, len(text), size)]
    parts = text.split(first)
    parts = [p for p in [parts[0], *(first + p for p in parts[1:])] if p]
    packed = []
    for part in parts:
        if packed and len(packed[-1]) + len(part) <= size:
            packed[-1] += part
        else:
            packed.append(part)
    return [piece for part in packed for piece in split_reference(part, size, rest)]


@pytest.mark.parametrize("size, separators", [(7, SEPARATORS), (40, SEPARATORS), (25, PLAIN_SEPARATORS)])
def test_chunks(spark, size, separators):
    rng = random.Random(size)
    bits = ["===== End Email Thread =====", "--- Email", "\n\n", "\n", " ", "  ", "word", "é", "😀", "a" * 60, "x.y"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.c for r in frame.select("i", chunking.chunk_text(F.col("t"), size, separators).alias("c")).collect()}
    for i, text in enumerate(texts):
        expected = [p.strip() for p in split_reference(text, size, separators)]
        assert got[i] == [p for p in expected if p]
        assert all(len(p) <= size for p in got[i])
        assert "".join("".join(got[i]).split()) == "".join(text.split())
    rows = chunking.explode_chunks(frame, chunking.chunk_text(F.col("t"), size, separators), "i").collect()
    assert sorted((r.i, r.chunk_no, r.text) for r in rows) == sorted((i, n, c) for i, cs in got.items() for n, c in enumerate(cs))


def test_long_single_line(spark):
    frame = spark.createDataFrame([("word " * 200_000 + "z" * 100_000,)], "t string")
    chunks = frame.select(chunking.chunk_text(F.col("t"), 1792).alias("c")).first().c
    assert max(map(len, chunks)) <= 1792 and "".join(chunks).count("z") == 100_000


def docs(spark, *texts):
    return spark.createDataFrame([(f"t{i}", 0, t) for i, t in enumerate(texts)], "thread_id string, segment bigint, text string")


def test_summary_in_one_pass(spark):
    text = "Cats sleep a lot in the sun all day. Dogs bark.\nCats eat fish and cats sleep in the sun.\n--- End Email ---\nNobody knows."
    got = summarize.summarize_documents(docs(spark, text), MailConfig(summary_sentences=2)).collect()
    assert [(r.thread_id, r.segment, r.summary) for r in got] == [
        ("t0", 0, "Cats sleep a lot in the sun all day.\nCats eat fish and cats sleep in the sun.")]


def test_summary_rounds(spark):
    """Groups fit the context; partial summaries are combined until one is left."""
    seen = spark.sparkContext.accumulator(0)
    cfg = MailConfig(context_tokens=500)
    budget = summarize.prompt_budget(cfg)
    assert budget == math.floor(500 * 3.5) - len(summarize.PROMPT) - 2

    def run(groups, prompt):
        longest = groups.agg(F.max(F.length("text"))).first()[0] or 0
        assert longest <= budget
        seen.add(1)
        return groups.withColumn("summary", F.concat(F.substring("text", 1, 20), F.lit("|")))

    text = "\n".join(f"line {i} of a long thread" for i in range(3000))
    got = summarize.summarize_documents(docs(spark, text, "short"), cfg, run).collect()
    assert {(r.thread_id, r.segment) for r in got} == {("t0", 0), ("t1", 0)}
    by_thread = {r.thread_id: r.summary for r in got}
    assert by_thread["t1"] == "short|" and by_thread["t0"].startswith("line 0 of") and len(by_thread["t0"]) == 21
    assert seen.value >= 3


def test_summary_that_does_not_shorten_keeps_everything(spark):
    cfg = MailConfig(context_tokens=500)
    text = "\n".join(f"line {i} of a long thread" for i in range(300))
    got = summarize.summarize_documents(docs(spark, text), cfg, lambda g, p: g.withColumn("summary", F.col("text"))).collect()
    assert len(got) == 1 and got[0].summary.split() == text.split()


def test_column_summarizer(spark):
    run = summarize.column_summarizer(lambda asked: F.upper(F.substring(asked, -3, 3)))
    got = summarize.summarize_documents(docs(spark, "abc"), MailConfig(), run).first()
    assert got.summary == "ABC"


def test_embedders(spark):
    frame = docs(spark, "one two two", "", "ONE, two! two?")
    embed = embedding.hashed_terms(64)
    got = {r.thread_id: r.e for r in frame.select("thread_id", embed(F.col("text")).alias("e")).collect()}
    assert got["t0"] == got["t2"] and len(got["t0"]) == 64
    assert abs(np.linalg.norm(got["t0"]) - 1) < 1e-6 and sorted(np.round(got["t0"], 4))[-2:] == [0.4472, 0.8944]
    assert not any(got["t1"])
    custom = embedding.model_embedder(lambda: lambda texts: [[float(len(t))] for t in texts], batch=2)
    assert sorted(r[0][0] for r in frame.select(custom(F.col("text"))).collect()) == [0.0, 11.0, 14.0]


def test_search(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = vectors.collect()
    question = rows[3].embedding
    found = search.top_k(vectors, question, 5, tie="vec_id")
    matrix = np.array([r.embedding for r in rows], dtype=float)
    scores = matrix @ np.array(question) / (np.linalg.norm(matrix, axis=1) * np.linalg.norm(question))
    best = sorted(range(len(rows)), key=lambda i: (-scores[i], rows[i].vec_id))[:5]
    assert [r.vec_id for r in found.collect()] == [rows[i].vec_id for i in best]
    assert "TakeOrderedAndProject" in found._jdf.queryExecution().executedPlan().toString()
    filtered = search.top_k(vectors, question, 3, {"label": rows[3].label}, tie="vec_id").collect()
    assert {r.label for r in filtered} == {rows[3].label}


def test_stats(spark):
    rng = random.Random(3)
    values = [int(rng.expovariate(1 / 3000)) + 1 for _ in range(1001)]
    frame = spark.createDataFrame([(v,) for v in values], "text_block_len bigint")
    got = stats.length_stats(frame).first()
    expected = [np.mean(values), np.median(values), np.std(values), *(np.percentile(values, p) for p in (90, 95, 99))]
    assert np.allclose([got["mean"], got["median"], got["stddev"], got["p90"], got["p95"], got["p99"]], expected, rtol=1e-9)
    assert (got["threads"], got["min"], got["max"]) == (1001, min(values), max(values))
    kept = [v for v in values if v <= np.percentile(values, 95)]
    heights, _ = np.histogram(kept, bins=80)
    bins = {r.bin: r.threads for r in stats.length_histogram(frame).collect()}
    assert [bins.get(i, 0) for i in range(80)] == list(heights)


def test_histogram_of_one_value(spark):
    frame = spark.createDataFrame([(5,), (5,)], "text_block_len bigint")
    assert [tuple(r) for r in stats.length_histogram(frame).collect()] == [(40, 2)]


def test_dump(spark, tmp_path):
    frame = spark.createDataFrame([("a\n\n \nb ", "sum", ("t", 'q"x', 3, True)), ("only", None, ("u", None, 4, False))],
                                  "text string, summary string, metadata struct<thread_id string, subject string, text_block_len bigint, is_summarized boolean>")
    entries = [r.value for r in dump.dump_entries(frame).collect()]
    metadata = {"thread_id": "t", "subject": 'q"x', "text_block_len": 3, "is_summarized": True}
    assert entries[0] == (
        dump.HEADER + "METADATA:\n" + json.dumps(metadata, indent=4) + "\n\n" + " " * 9 + "a\n\n\n" + " " * 9 + "b\n\n"
        + "Text Block Summarized:\n\n" + " " * 9 + "sum\n\n")
    assert "Summarized" not in entries[1] and '"subject": null' in entries[1]
    dump.write_dump(frame, str(tmp_path / "d"))
    assert sorted(r[0] for r in dump.read_dump_lengths(spark, str(tmp_path / "d")).collect()) == [3, 4]


def test_models(spark):
    catalog = {r.model: r for r in models.model_catalog(spark).collect()}
    assert len(catalog) == 9 and catalog["bge-large-en-v1.5"].max_chars == 1792 and catalog["bge-m3"].max_chars == 28672
    assert models.chunk_chars(MailConfig()) == 1792 and models.chunk_chars(MailConfig(chunk_size=9)) == 9
    assert MailConfig().collection_name == "email_threads_bge-large-en-v1.5"
    with pytest.raises(ValueError):
        models.chunk_chars(MailConfig(embed_model="none"))


def test_chunking_is_linear(spark):
    """Ten million characters of blank-line text in seconds, on one core."""
    text = "\n\n".join(f"line {i} of a long text" for i in range(400_000))
    frame = spark.createDataFrame([(text,)], "t string").coalesce(1)
    start = time.perf_counter()
    found = frame.select(chunking.chunk_text(F.col("t"), 1792).alias("c")).select(F.size("c"), F.aggregate("c", F.lit(0), lambda n, c: F.greatest(n, F.length(c)))).first()
    assert time.perf_counter() - start < 30
    assert found[0] >= len(text) // 1792 and found[1] <= 1792


@pytest.mark.parametrize("seed", range(4))
def test_chunks_of_segments(spark, seed):
    """Segments give the chunks of the joined text, wherever it was cut."""
    rng = random.Random(seed)
    size, mark = 60, "\n\n"
    texts = {}
    for t in range(40):
        parts = ["x" * rng.choice([0, 1, 3, 10, 25, 58, 59, 60, 61, 150]) + str(k) for k in range(rng.randrange(1, 40))]
        texts[f"t{t}"] = parts
    texts[None] = ["a", "b"]
    rows = []
    for thread, parts in texts.items():
        at, number = 0, 0
        while at < len(parts):
            step = rng.choice([1, 1, 2, 5, 20])
            rows.append((thread, number, mark.join(parts[at:at + step])))
            at, number = at + step, number + 1
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "thread_id string, segment bigint, text string")
    got = {}
    for r in packing.chunk_segments(frame, size, PLAIN_SEPARATORS, packing.Layout(mark)).collect():
        got.setdefault(r.thread_id, {})[r.chunk_no] = r.text
    whole = spark.createDataFrame([(t, mark.join(p)) for t, p in texts.items()], "t string, s string")
    want = {r.t: dict(enumerate(r.c)) for r in whole.select("t", chunking.chunk_text(F.col("s"), size, PLAIN_SEPARATORS).alias("c")).collect() if r.c}
    assert got == want
