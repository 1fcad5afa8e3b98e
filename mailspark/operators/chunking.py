"""Splitting documents into pieces of a bounded length."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.config import SEPARATORS
from mailspark.functions.text import strip


def _overlaps_itself(separator: str) -> bool:
    return any(separator.startswith(separator[k:]) for k in range(1, len(separator)))


def _by_regex(separator: str, size: int):
    """Pieces of one level as the successive matches of a regex.

    Each match ends where the separator starts again (it stays at the head of the
    next piece) and is the longest such stretch within ``size`` characters; a
    single stretch that is longer comes whole and is left to the next level.
    """
    ahead = rf"(?={re.escape(separator)}|\z)"
    regex = f"(?s).{{1,{size}}}{ahead}|.+?{ahead}" if separator else f"(?s).{{1,{size}}}"
    return lambda text: F.regexp_extract_all(text, F.lit(regex), F.lit(0))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _by_pieces(separator: str, size: int):
    """The same for a separator that can overlap itself, such as two line feeds
    in a run of three: occurrences are taken from the left, which a look-ahead
    cannot tell. Matches are the pieces, each with its separator ahead; a fold over
    their lengths says where chunks end, and touches no text."""
    mark, ahead = re.escape(separator), rf"(?={re.escape(separator)}|\z)"
    regex = f"(?s){mark}.*?{ahead}|.+?{ahead}"

    def pack(pieces: Column) -> Column:
        start = F.struct(
            F.lit(0).alias("chars"), F.lit(0).alias("pieces"), F.array().cast("array<int>").alias("ends"))

        def add(state: Column, piece: Column) -> Column:
            length, count = F.length(piece), state["pieces"]
            fits = (count == 0) | (state["chars"] + length <= size)
            return F.struct(
                F.when(fits, state["chars"] + length).otherwise(length).alias("chars"), (count + 1).alias("pieces"),
                F.when(fits, state["ends"]).otherwise(F.concat(state["ends"], F.array(count))).alias("ends"))

        def join(ends: Column) -> Column:
            def one(end: Column, k: Column) -> Column:
                begin = F.when(k > 0, F.get(ends, k - 1)).otherwise(0)
                return F.array_join(F.slice(pieces, begin + 1, end - begin), "")

            return F.transform(ends, one)

        ends = F.aggregate(pieces, start, add, lambda state: F.concat(state["ends"], F.array(state["pieces"])))
        return _bound(ends, join)

    return lambda text: _bound(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), pack)


def chunk_text(text: Column, size: int, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """``text`` as an array of stripped chunks, none longer than ``size``.

    Pieces that are still too long are split again by the next separator; a piece
    without it, or short enough, is passed on as it is.
    """
    def split_level(pieces: Column, separator: str) -> Column:
        split = (_by_pieces if _overlaps_itself(separator) else _by_regex)(separator, size)

        def split_long(piece: Column) -> Column:
            done = (F.length(piece) <= size) | ~piece.contains(separator)
            return F.when(done, F.array(piece)).otherwise(split(piece))

        return F.flatten(F.transform(pieces, split_long))

    pieces = F.array(text)
    for separator in separators:
        pieces = split_level(pieces, separator)
    pieces = F.when(F.length(text) <= size, F.array(text)).otherwise(pieces)
    return F.filter(F.transform(pieces, strip), lambda piece: piece != "")


def explode_chunks(df: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """One row per chunk, numbered from 0."""
    # posexplode_outer: the inner form repeats the chunking in an inferred filter.
    rows = df.select(*keep, F.posexplode_outer(chunks).alias("chunk_no", "text"))
    return rows.where(F.col("text").isNotNull()).withColumn("chunk_no", F.col("chunk_no").cast("bigint"))
