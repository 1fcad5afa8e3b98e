"""Quoted replies: where the quote starts, and whether it repeats the parent."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.config import QUOTE_PATTERNS, MailConfig
from mailspark.functions.text import strip
from mailspark.operators.similarity import alike, bound_reaches

# Unicode-aware ignore-case, and "." stops at line feeds only.
_FLAGS = "(?iud)"


# How each introduction is searched; the matches are the same. An attribution needs
# its closing word on the same line, so only lines that have it are searched, up to
# its last place. A run of dashes can only match from its start on.
_ATTRIBUTION, _CLOSE = QUOTE_PATTERNS[0], "wrote:"


def _searched(pattern: str) -> str:
    return _FLAGS + (re.sub(r"^(-+)\+", r"(?<!-)\1++", pattern) if pattern.startswith("-") else pattern)


def _attribution_split(body: Column) -> Column:
    """``[before, after]`` around the first attribution; NULL without one."""
    # The part of a line up to the last closing word, if it holds an attribution.
    head = lambda line: F.regexp_extract(line, f"{_FLAGS}^(.*{_CLOSE})", 1)
    hit = lambda line: head(line).rlike(_FLAGS + _ATTRIBUTION)

    def around(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, hit), True).cast("int")

        def cut(line: Column) -> Column:
            found = head(line)
            start = F.regexp_instr(found, F.lit(_FLAGS + _ATTRIBUTION))
            length = F.length(F.regexp_extract(found, _FLAGS + f"({_ATTRIBUTION})", 1))
            before = F.concat(F.slice(lines, 1, at - 1), F.array(F.substring(line, F.lit(1), start - 1)))
            after = F.concat(
                F.array(F.substring(line, start + length, F.length(line))),
                F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0))))
            return F.array(F.array_join(before, "\n"), F.array_join(after, "\n"))

        return F.when(at > 0, F.transform(F.array(F.get(lines, at - 1)), cut)[0])

    lines = F.split(body, "\n")
    # Most bodies have no closing word at all.
    return F.when(body.rlike(f"{_FLAGS}{_CLOSE}"), F.transform(F.array(lines), around)[0])


def quote_split(body: Column) -> Column:
    """``[before, after]`` around the first pattern, in list order, that occurs."""
    split = F.lit(None).cast("array<string>")
    for pattern in reversed(QUOTE_PATTERNS[1:]):
        regex = _searched(pattern)
        split = F.when(body.rlike(regex), F.split(body, regex, 2)).otherwise(split)
    return F.coalesce(_attribution_split(body), split)


def _unprefixed(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?m)^(?:> ?)+", ""))


def _diff(left, right, threshold: float, autojunk: bool):
    if left is None or right is None:
        return None
    # An upper bound and linear; ratio is quadratic.
    if not bound_reaches(left, right, threshold):
        return False
    # Below 200 characters there is no junk.
    if autojunk and len(right) >= 200:
        return difflib.SequenceMatcher(None, left, right, autojunk).ratio() >= threshold
    return alike(left, right, threshold)


def diff_verdicts(quoted: Column, originals: Column, cfg: MailConfig) -> Column:
    """Element-wise diff verdicts of two arrays; NULL where either is NULL."""
    threshold, autojunk = cfg.similarity, cfg.autojunk

    @F.pandas_udf("array<boolean>")
    def close(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([
            [_diff(a, b, threshold, autojunk) for a, b in zip(xs, ys)] for xs, ys in zip(left, right)
        ])

    # Marked so that no filter on the outcome runs the diff a second time.
    return close.asNondeterministic()(quoted, originals)


def quoted_part(quote: Column, cfg: MailConfig) -> Column:
    """The stripped text after the quote mark, as it enters the comparison."""
    text = strip(quote[1])
    return _unprefixed(text) if cfg.strip_quote_prefix else text


def settled(quoted: Column, original: Column, cfg: MailConfig) -> Column:
    """The verdict that equality or the length bound gives; NULL if neither does."""
    total = F.length(quoted) + F.length(original)
    bound = F.least(F.length(quoted), F.length(original)) * F.lit(2.0) / total
    return F.when(quoted == original, True).when(bound < cfg.similarity, False)


def reply_parents(emails: DataFrame) -> DataFrame:
    """Replies with their parent inside the same thread; others get NULL."""
    parents = emails.select(
        F.col("thread_id").alias("_thread"), F.col("id").alias("parent_id"),
        F.col("body").alias("parent_body"),
    )
    same = F.col("thread_id").eqNullSafe(F.col("_thread")) & (F.col("in_reply_to") == F.col("parent_id"))
    return emails.join(parents, same, "left").drop("_thread")


def _fingerprint(text: Column) -> Column:
    return F.struct(F.length(text).alias("length"), F.md5(F.encode(text, "utf-8")).alias("digest"))


def strip_quotes(emails: DataFrame, cfg: MailConfig) -> DataFrame:
    """Adds ``text``: the body without the quoted parent, except for the first
    email of a thread.

    A reply first meets the length and a digest of its parent, which settles most
    cases; a parent's text travels only to the replies that are still open. Every
    shuffle is on a unique message id or on a pair with one, never on the thread
    alone.
    """
    first = emails.groupBy("thread_id").agg(F.min(F.struct("date", "id")).alias("_first"))
    first = first.select(F.col("_first.id").alias("id"), F.lit(True).alias("_is_first"))
    parents = emails.select(
        F.col("thread_id").alias("_thread"), F.col("id").alias("_parent"), _fingerprint(strip(F.col("body"))).alias("_print"))
    same = F.col("thread_id").eqNullSafe(F.col("_thread")) & (F.col("in_reply_to") == F.col("_parent"))
    mails = emails.join(parents, same, "left").join(first, "id", "left")
    answers = F.col("_parent").isNotNull() & F.col("_is_first").isNull()
    mails = mails.withColumn("_quote", F.when(answers, quote_split(F.col("body"))))
    mails = mails.withColumn("_tail", quoted_part(F.col("_quote"), cfg))
    tail, other = _fingerprint(F.col("_tail")), F.col("_print")
    shorter = F.least(tail["length"], other["length"]) * F.lit(2.0) / (tail["length"] + other["length"])
    mails = mails.withColumn("_settled", F.when(tail == other, True).when(shorter < cfg.similarity, False))
    open_case = F.col("_tail").isNotNull() & F.col("_settled").isNull()
    # Only open replies carry the key of their parent into the second join.
    mails = mails.withColumns({"_key": F.when(open_case, F.col("_parent")), "_in": F.when(open_case, F.col("_thread"))})
    bodies = emails.select(F.col("thread_id").alias("_of"), F.col("id").alias("_id"), F.col("body").alias("_body"))
    asked = mails.where(open_case).select("id", "_key", "_in", "_tail")
    asked = asked.join(bodies, (F.col("_key") == F.col("_id")) & F.col("_in").eqNullSafe(F.col("_of")))
    verdict = diff_verdicts(F.array("_tail"), F.array(strip(F.col("_body"))), cfg)[0]
    verdicts = asked.select(F.col("id").alias("_asked"), verdict.alias("_verdict"))
    mails = mails.join(verdicts, F.col("id") == F.col("_asked"), "left")
    quoted = F.coalesce("_settled", "_verdict", F.lit(False))
    text = F.when(quoted, F.col("_quote")[0]).otherwise(F.col("body"))
    return mails.withColumn("text", strip(text)).select(*emails.columns, "text")
