"""Sentences are scored inside their row, without a row per word."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from mailspark.functions.text import words
from mailspark.operators.frequencies import WordWeights
from mailspark.operators.summarize import extractive, sentences

SCHEMA = "thread_id string, segment bigint, group_no bigint, text string"
ROWS = [
    ("a", 0, 0, "Red fox. Red hill! Blue\nred red red sky of a very long line that has many words\n...\nlast"),
    ("a", 0, 1, "tie one\ntie two\ntie three"), ("b", 0, 0, "größe Größe. \n--- cut\nx"), ("c", 0, 0, ""), ("d", 0, 0, None),
    (None, 0, 0, "no thread"), ("e", 0, 0, "... \n!!!"),
]


def expected(lines, tokens, top, weight):
    counts = Counter(w for line in tokens for w in line)
    score = [sum(counts[w] * weight(w) for w in line) / max(len(line), 8) for line in tokens]
    best = sorted(sorted(range(len(lines)), key=lambda i: (-score[i], i))[:top])
    return "\n".join(lines[i] for i in best)


@pytest.mark.parametrize("small", [None, 2, 100])
@pytest.mark.parametrize("top", [1, 2, 50])
def test_scores_are_those_of_counted_words(spark, top, small):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    weights = None if small is None else WordWeights(frame.where("thread_id <> 'b'"), small)
    known = {} if weights is None else {r["word"]: r["weight"] for r in weights.table.collect()}
    weight = (lambda w: 1) if weights is None else (lambda w: known.get(w, weights.unknown))
    got = {(r.thread_id, r.group_no): r.summary for r in extractive(top, weights)(frame, "").collect()}
    split = frame.where("thread_id IS NOT NULL").select("thread_id", "group_no", sentences(F.col("text")).alias("l"))
    split = split.select("*", F.transform("l", words).alias("t")).where(F.size("l") > 0).collect()
    assert got == {(r.thread_id, r.group_no): expected(r.l, r.t, top, weight) for r in split}


def test_no_word_becomes_a_row(spark):
    plan = extractive(3)(spark.createDataFrame(ROWS, SCHEMA), "")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
