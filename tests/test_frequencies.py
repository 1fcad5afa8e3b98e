import math

import pytest

from mailspark.config import MailConfig
from mailspark.operators.frequencies import WordWeights, document_frequencies
from mailspark.operators.summarize import extractive, summarize_documents

SCHEMA = "thread_id string, segment bigint, text string"
DOCS = [
    ("a", 0, "Red red fox"), ("a", 1, "fox hill"), ("b", 0, "red, hill!"), ("c", 0, "red sky"), ("d", 0, ""), ("e", 0, None),
]


def weight(number, documents):
    return math.floor(math.log((1 + number) / (1 + documents)) * 1000)


def test_a_thread_counts_a_word_once(spark):
    got = {r["word"]: r["documents"] for r in document_frequencies(spark.createDataFrame(DOCS, SCHEMA), 10).collect()}
    assert got == {"red": 3, "fox": 1, "hill": 2, "sky": 1}


@pytest.mark.parametrize("small", [2, 4, 100])
def test_frequent_and_rare_words_get_their_weights(spark, small):
    weights = WordWeights(spark.createDataFrame(DOCS, SCHEMA), small)
    rows = spark.createDataFrame([(w,) for w in ["red", "fox", "hill", "sky", "new", None, "red", "sky"]], "word string")
    got = sorted((r["word"] or "", r["weight"]) for r in weights.weigh(rows).collect())
    want = {"red": weight(5, 3), "fox": weight(5, 1), "hill": weight(5, 2), "sky": weight(5, 1), "new": weight(5, 0), "": 0}
    assert got == sorted((w, want[w]) for w in ["red", "fox", "hill", "sky", "new", "", "red", "sky"])


def test_an_empty_corpus(spark):
    weights = WordWeights(spark.createDataFrame([], SCHEMA), 10)
    assert [r["weight"] for r in weights.weigh(spark.createDataFrame([("x",)], "word string")).collect()] == [0]


def test_rare_words_make_a_sentence_matter(spark):
    """The thread says the common words more often; the corpus says they are common."""
    common = "please see the mail please see the mail please see the mail."
    rare = "turbine bearings failed in turbine hall, order new turbine bearings."
    docs = [("t", 0, f"{common}\n{rare}")] + [(f"o{i}", 0, f"{common} number{i}") for i in range(30)]
    frame = spark.createDataFrame(docs, SCHEMA)
    cfg = MailConfig()

    def summary(summarizer):
        return {r["thread_id"]: r["summary"] for r in summarize_documents(frame, cfg, summarizer).collect()}["t"]

    assert summary(extractive(1)) == common
    assert summary(extractive(1, WordWeights(frame, cfg.small_keys))) == rare
