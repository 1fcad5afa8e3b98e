"""Summaries of threads that would give too many chunks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.config import MailConfig
from mailspark.functions.text import strip, words
from mailspark.operators.chunking import chunk_text
from mailspark.operators.frequencies import WordWeights
from mailspark.operators.packing import Layout, chunk_segments
from mailspark.operators.skew import KeySet, running_sums
from mailspark.operators.threads import LAYOUT
from mailspark.session import stored
from mailspark.sources.models import context_chars

# What a language model is asked, in front of the text.
PROMPT = """
You are an assistant that summarizes long email threads.

The email thread is structured as follows:
- The entire thread is wrapped with: `===== Begin Email Thread =====` and `===== End Email Thread =====`
- Each email starts with `--- Email N ---` and ends with `--- End Email ---`
- If there are any attachments, they are shown between `--- Begin Attachment: <filename> (<filetype>) ---` and `--- End Attachment ---`

Provide a concise summary of the overall thread, capturing:
- The main topic or subject of the conversation
- Any requests for help, questions being asked, or issues raised by the sender(s)
- Any key decisions or actions mentioned
- Important dates or numbers if mentioned

Only summarize what's relevant. Do not repeat all emails.
Highlight help requests clearly (if any) so a human can follow up if needed.

Here is the email thread:
"""
COMBINE_PROMPT = """
You are an assistant that combines multiple partial summaries of an email thread into one cohesive final summary.

Each input summary covers a portion of a long email conversation. Your task is to merge them into a single summary that:
- Preserves the main topics and themes from all parts
- Captures all important requests, decisions, and actions mentioned
- Avoids repetition or unnecessary detail
- Retains important dates, names, or figures if mentioned
- Presents the summary in clear, concise, and structured language

Here are the partial summaries:
"""
_JOINER = "\n\n"
# How joined summaries continue from segment to segment.
JOINED = Layout(_JOINER)
_FULL_SENTENCE = 8

# A summarizer takes rows (thread_id, segment, group_no, text) and a prompt and
# returns them with column ``summary``.
Summarizer = Callable[[DataFrame, str], DataFrame]


def column_summarizer(function: Callable[[Column], Column]) -> Summarizer:
    """A summarizer from a column function or UDF that gets the whole prompt."""
    def run(groups: DataFrame, prompt: str) -> DataFrame:
        asked = F.concat(F.lit(prompt + _JOINER), F.col("text"))
        return groups.withColumn("summary", function(asked))

    return run


def sentences(text: Column) -> Column:
    """Sentences and lines, stripped, in order; separator lines are left out."""
    parts = F.split(F.regexp_replace(text, r"([.!?]) +", "$1\n"), "\n")
    kept = F.transform(parts, strip)
    return F.filter(kept, lambda s: (s != "") & ~s.rlike("^(---|=====|Date: )"))


def extractive(top: int, weights: WordWeights | None = None) -> Summarizer:
    """The ``top`` sentences with the highest mean word frequency, in order; with
    ``weights``, frequencies times the weight of the word in a corpus.

    A group is no longer than the model context and lies in one row, so its words are
    counted where it is: no word becomes a row, and nothing is shuffled or sorted but the
    weights of words that are not among the frequent ones.
    """
    group = ["thread_id", "segment", "group_no"]

    def run(groups: DataFrame, prompt: str) -> DataFrame:
        named = [F.col(c).isNotNull() for c in group]
        rows = groups.where(named[0] & named[1] & named[2]).select(*group, sentences(F.col("text")).alias("lines"))
        rows = rows.where(F.size("lines") > 0)
        tokens, rare = F.transform("lines", words), F.lit(None).cast(WEIGHED)
        if weights is not None and not weights.whole:
            found = weights.rare(rows.select(*group, F.explode(F.array_distinct(F.flatten(tokens))).alias("word")))
            found = found.groupBy(*group).agg(F.collect_list(F.struct("word", "weight")).alias("rare"))
            rows, rare = rows.join(found, group, "left"), F.col("rare")
        places = _places(top, weights)(tokens, rare)
        picked = F.transform(places, lambda at: F.get(F.col("lines"), at))
        return rows.select(*group, F.array_join(picked, "\n").alias("summary"))

    return run


# Words with their weights.
WEIGHED = "array<struct<word:string,weight:bigint>>"


def _places(top: int, weights: WordWeights | None) -> Callable[[Column, Column], Column]:
    """The places of the best sentences of texts ``array<array<string>>``, in order; the
    second argument has the weights of words that are not frequent."""
    frequent = None if weights is None else weights.local()
    unknown = 0 if weights is None else weights.unknown

    @F.arrow_udf("array<int>")
    def places(tokens: pa.Array, rare: pa.Array) -> pa.Array:
        out = []
        for at in range(len(tokens)):
            lines = tokens[at].values
            coded = lines.flatten().dictionary_encode()
            codes = coded.indices.to_numpy()
            value = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int64)
            if frequent is not None:
                words_, weight = frequent
                others = rare[at].values
                if others is not None and len(others):
                    words_ = pa.concat_arrays([words_, others.field("word")])
                    weight = np.concatenate([weight, others.field("weight").to_numpy(zero_copy_only=False)])
                met = pc.index_in(coded.dictionary, words_).fill_null(len(words_)).to_numpy()
                value = value * np.append(weight, unknown)[met]
            length = lines.value_lengths().to_numpy()
            ends = np.cumsum(length)
            upto = np.append(0, np.cumsum(value[codes]))
            # Sentences of a few words do not win by being short.
            score = (upto[ends] - upto[ends - length]) / np.maximum(length, _FULL_SENTENCE)
            out.append(np.sort(np.argsort(-score, kind="stable")[:top]))
        return pa.array(out, pa.list_(pa.int32()))

    return places


def prompt_budget(cfg: MailConfig) -> int:
    """Characters left for text once the prompt and its joiner are in."""
    return max(1, context_chars(cfg) - len(PROMPT) - len(_JOINER))


def _groups(documents: DataFrame, budget: int, cfg: MailConfig, layout: Layout) -> DataFrame:
    """Documents in groups within the budget, each on its own row. A document in
    segments gives the groups of the whole."""
    several = KeySet(documents.where("segment > 0").select("thread_id").distinct(), "thread_id", cfg.small_keys)
    whole = several.outside(documents)
    fits = F.length("text") <= budget
    pieces = F.when(fits, F.array("text")).otherwise(chunk_text(F.col("text"), budget, cfg.separators))
    zero = F.lit(0).cast("bigint").alias("segment")
    rows = whole.select("thread_id", zero, F.posexplode_outer(pieces).alias("group_no", "text")).where(F.col("text").isNotNull())
    rows = rows.withColumn("group_no", F.col("group_no").cast("bigint"))
    if several.empty:
        return rows
    cut = chunk_segments(several.inside(documents), budget, cfg.separators, layout)
    return rows.unionByName(cut.select("thread_id", zero, F.col("chunk_no").alias("group_no"), "text"))


def _rejoined(parts: DataFrame, cfg: MailConfig) -> DataFrame:
    """Partial summaries of each thread joined in order, again as documents whose
    segments stay within what a task holds."""
    size = (F.length("summary") + len(_JOINER)).cast("bigint")
    placed = running_sums(
        parts, "thread_id", ["segment", "group_no"], {"upto": size}, cfg.heavy_rows, cfg.small_keys,
    )
    ordered = F.array_sort(F.collect_list(F.struct("segment", "group_no", "summary")))
    placed = placed.withColumn("pack", F.floor((F.col("upto") - size) / cfg.heavy_chars))
    return placed.groupBy("thread_id", "pack").agg(
        F.array_join(F.transform(ordered, lambda p: p["summary"]), _JOINER).alias("text")
    ).select("thread_id", F.col("pack").cast("bigint").alias("segment"), "text")


def summarize_documents(documents: DataFrame, cfg: MailConfig, summarizer: Summarizer | None = None) -> DataFrame:
    """``(thread_id, segment, summary, is_final)`` of ``(thread_id, segment, text)``.

    Texts within the context are summarized in one pass. Longer ones are split
    into groups that fit, and the joined partial summaries of a thread are
    summarized again, round after round, until one group is left. If a round does
    not bring the number of groups down, the joined partial summaries stand as
    they are, marked by ``is_final`` being false; nothing is cut off. Only there can
    a thread too large for one task end up with more than one segment, to be joined
    by blank lines.

    Each round is stored, because a model should not be asked twice and the next
    round depends on its size.
    """
    summarizer = summarizer or extractive(cfg.summary_sentences)
    budget = prompt_budget(cfg)
    prompt, before, layout = PROMPT, None, LAYOUT
    finished = []
    while True:
        groups = _groups(documents, budget, cfg, layout)
        parts = stored(summarizer(groups, prompt).select("thread_id", "segment", "group_no", "summary"), "summaries")
        sizes = parts.groupBy("thread_id").agg(F.count("*").alias("n"))
        total, most = sizes.agg(F.sum("n"), F.max("n")).first()
        if (most or 0) <= 1:
            finished.append(parts.select("thread_id", "segment", "summary", F.lit(True).alias("is_final")))
            break
        counted = parts.join(sizes, "thread_id")
        single = counted.where("n = 1")
        finished.append(single.select("thread_id", F.lit(0).cast("bigint").alias("segment"), "summary", F.lit(True).alias("is_final")))
        documents = _rejoined(counted.where("n > 1").drop("n"), cfg)
        if before is not None and total >= before:
            finished.append(documents.select("thread_id", "segment", F.col("text").alias("summary"), F.lit(False).alias("is_final")))
            break
        prompt, before, layout = COMBINE_PROMPT, total, JOINED

    result = finished[0]
    for more in finished[1:]:
        result = result.unionByName(more)
    return result
