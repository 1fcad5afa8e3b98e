"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes of a text: h = 2h + gear[byte] modulo 2^32, so it
depends on the last 32 bytes only. A chunk ends where the hash is the largest
within ``REACH`` bytes on both sides. Borders thus depend on the text around them
and on nothing else: what is inserted before a passage does not shift the chunks
in it. Chunks are compared by a 64-bit digest; one whose digest occurs in two or
more documents is repeated.

Whole chunks only tell where to look. Neighbouring repeated chunks that stand side by
side in one other document as well, the first that has them or else the last, are a
piece, which is extended byte by byte against the text of that document. Pieces that
touch form a stretch, and a stretch counts from ``MIN_WORDS`` words on. In it the first
document, by doc_id, that has a byte's piece keeps the byte; a stretch is cut into
passages where that document changes, so a passage can be shorter than ``MIN_WORDS``
if its stretch is not. What a document drops is thus always in an earlier one.

A passage without a whole chunk in common is not seen; the README has figures.

Cases: null and empty texts have no chunks. Rows that share a doc_id are one
document, so they repeat nothing of each other; a row without doc_id is known by
its text. A text without any border is one chunk; in a stretch that repeats itself at
short intervals every interval has a border.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailspark.llm.common import own_names
from mailspark.llm.textbytes import mix, word_bounds
from mailspark.session import checkpointed, stored

REACH = 24
_LONG = 8 * REACH
MIN_WORDS = 24

# A border is decided by at most so many bytes before and after it, so what two texts share
# ends less than this beyond the chunk next to the last one they have in common.
_BEFORE, _AFTER = REACH + 32 + 4, REACH + 4

_GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
_PLACE = np.random.default_rng(5).integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after every byte, by doubling instead of a loop."""
    out = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        shifted = out.copy()
        shifted[step:] += out[:-step] << np.uint32(step)
        out = shifted
    return out


def _window_max(values: np.ndarray, width: int) -> np.ndarray:
    """Maxima of all windows of ``width`` values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.maximum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.maximum(out[:len(out) - (width - have)], out[width - have:])
    return out


def borders(data: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Chunk ends: 0, every place where the hash peaks, and the length."""
    n = len(data)
    inner = np.empty(0, dtype=np.int64)
    if n > 2 * reach:
        hashes = gear_hashes(data)
        highest = _window_max(hashes, reach)
        before, here, after = highest[:n - 2 * reach], hashes[reach:n - reach], highest[reach + 1:]
        # Above all before and not below any after: in a run of equal bytes no place is.
        inner = np.flatnonzero((here > before) & (here >= after)) + reach + 1
        long_ = np.flatnonzero(np.diff(np.concatenate([[0], inner, [n]])) > _LONG)
        if len(long_):
            inner = _in_periods(inner, long_, np.flatnonzero((here >= before) & (here >= after)) + reach + 1, n, reach)
        for _ in range(3):  # not inside a character
            inner = inner + ((data[np.minimum(inner, n - 1)] & 0xC0) == 0x80)
        inner = np.unique(inner[inner < n])
    return np.concatenate([[0], inner, [n]]).astype(np.int64)


def _in_periods(inner: np.ndarray, long_: np.ndarray, level: np.ndarray, n: int, reach: int) -> np.ndarray:
    """Adds borders to stretches without a peak. They are periodic, with a highest
    place in every period; every one that is ``reach`` after the last becomes a
    border, so that equal periods give equal chunks."""
    ends = np.concatenate([[0], inner, [n]])
    more = []
    for k in long_:
        at, stop = ends[k], ends[k + 1]
        places = level[np.searchsorted(level, at + reach):np.searchsorted(level, stop)]
        while len(places):
            more.append(places[0])
            places = places[np.searchsorted(places, places[0] + reach):]
    return np.unique(np.concatenate([inner, np.array(more, dtype=np.int64)]))


def _digests(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of every chunk."""
    lengths = np.diff(ends)
    within = np.arange(len(data)) - np.repeat(ends[:-1], lengths)
    # Bytes are weighed by place; places beyond the table are scrambled by their lap.
    lap = (within // len(_PLACE)).astype(np.uint64)
    weighed = mix((data.astype(np.uint64) + np.uint64(1)) * _PLACE[within % len(_PLACE)] + lap)
    sums = np.add.reduceat(weighed, ends[:-1])
    return mix(sums ^ mix(lengths.astype(np.uint64)))


def _texts(docs: DataFrame) -> DataFrame:
    """``doc, text`` as bytes of all rows that have a text."""
    return docs.where("text IS NOT NULL AND text <> ''").select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text")).alias("doc"), F.col("text").cast("binary").alias("text"))


def _around(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes before and after each chunk can belong to what it is part of."""
    n = len(data)
    low = np.maximum(np.concatenate([[0], ends[:-2]]) - _BEFORE, 0)
    high = np.minimum(np.concatenate([ends[2:], [n]]) + _AFTER, n)
    for _ in range(3):  # not inside a character
        low = low - ((low > 0) & ((data[low] & 0xC0) == 0x80))
        high = high + ((high < n) & ((data[np.minimum(high, n - 1)] & 0xC0) == 0x80))
    return ends[:-1] - low, high - ends[1:]


def chunks(docs: DataFrame) -> DataFrame:
    """``doc, number, start, end, word, words, before, after, digest`` of all chunks; places
    in bytes, ``word`` counts the words that begin before the chunk."""
    numbers = ["number", "start", "end", "word", "words", "before", "after"]

    def run(batches):
        for batch in batches:
            parts = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.frombuffer(text.as_py(), dtype=np.uint8)
                ends = borders(data)
                starts, _ = word_bounds(data)
                word = np.searchsorted(starts, ends)
                before, after = _around(data, ends)
                count = len(ends) - 1
                small = (np.arange(count), ends[:-1], ends[1:], word[:-1], np.diff(word), before, after)
                parts.append((np.full(count, doc), *[x.astype(np.int32) for x in small], _digests(data, ends).view(np.int64)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["doc", *numbers, "digest"])

    return _texts(docs).mapInArrow(run, f"doc bigint, {', '.join(f'{x} int' for x in numbers)}, digest bigint")


def _pieces(docs: DataFrame) -> DataFrame:
    """Neighbouring repeated chunks of ``doc`` that are neighbours in ``other`` as well,
    ``shift`` bytes further on: the first document that has them, or the last one if
    ``doc`` is the first."""
    made = stored(chunks(docs), "chunks")
    place = F.struct("doc", "start")
    seen = made.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # A table of its own, so that the join below can split a very common chunk.
    seen = checkpointed(seen.where("first.doc < last.doc"))
    # Rows that share a document give the same chunk twice.
    repeated = made.join(seen, "digest").dropDuplicates(["doc", "number", "start", "end"])
    other = F.when(F.col("doc") == F.col("first.doc"), F.col("last")).otherwise(F.col("first"))
    repeated = repeated.withColumn("holder", other).select(
        "doc", "number", "start", "end", "word", "words", "before", "after",
        F.col("holder.doc").alias("other"), (F.col("holder.start") - F.col("start")).alias("shift"))
    beside = Window.partitionBy("doc", "other", "shift").orderBy("number", "start")
    runs = repeated.withColumn("run", F.col("number") - F.row_number().over(beside))
    return runs.groupBy("doc", "other", "shift", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("word").alias("word"),
        F.max(F.col("word") + F.col("words")).alias("last_word"), F.min_by("before", "start").alias("before"),
        F.max_by("after", "start").alias("after")).drop("run")


def _matched(own: bytes, other: bytes, ahead: bool) -> tuple[int, int]:
    """How many bytes two contexts share, from their beginning or up to their end, and
    how many words begin in these. The first byte ahead is of the chunk itself."""
    m = min(len(own), len(other))
    if m == 0:
        return 0, 0
    a, b = (own[:m], other[:m]) if ahead else (own[-m:], other[-m:])
    order = "big" if ahead else "little"
    k = m - ((int.from_bytes(a, order) ^ int.from_bytes(b, order)).bit_length() + 7) // 8
    # Not inside a character.
    if ahead:
        while k < len(own) and k > 1 and own[k] & 0xC0 == 0x80:
            k -= 1
    else:
        while k and own[len(own) - k] & 0xC0 == 0x80:
            k -= 1
    starts, _ = word_bounds(np.frombuffer(own, dtype=np.uint8))
    if ahead:
        return k - 1, int(((starts >= 1) & (starts < k)).sum())
    return k, int((starts >= len(own) - k).sum())


def _extended(pieces: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc, first_doc, start, end, word, last_word`` of the pieces with all bytes beside them that
    ``doc`` and ``other`` share."""
    keys = ["doc", "other", "shift", "start", "end", "word", "last_word"]
    # Ahead from the last byte of the piece, to know whether a word begins behind it.
    sides = F.array(
        F.struct(F.lit(False).alias("ahead"), F.col("start").alias("at"), F.col("before").alias("span")),
        F.struct(F.lit(True).alias("ahead"), (F.col("end") - 1).alias("at"), (F.col("after") + 1).alias("span")))
    edges = pieces.select(*keys, F.inline(sides)).withColumn("other_at", F.col("at") + F.col("shift"))
    asked = edges.select("doc", "ahead", "at", "span").unionByName(
        edges.select(F.col("other").alias("doc"), "ahead", F.col("other_at").alias("at"), "span"))
    asked = asked.groupBy("doc", "ahead", "at").agg(F.max("span").alias("span"))
    asked = asked.groupBy("doc").agg(F.collect_list(F.struct("ahead", "at", "span")).alias("asked"))
    low = F.greatest(F.col("at") - F.col("span"), F.lit(0))
    cut = F.when(F.col("ahead"), F.substring("text", F.col("at") + 1, F.col("span")))
    cut = cut.otherwise(F.substring("text", low + 1, F.col("at") - low))
    found = _texts(docs).join(asked, "doc").select("doc", "text", F.inline("asked")).select("doc", "ahead", "at", cut.alias("bytes"))
    # Equal rows of a document give the same context again.
    found = stored(found.repartition("doc", "ahead", "at").dropDuplicates(["doc", "ahead", "at", "bytes"]), "contexts")
    met = edges.join(found.withColumnRenamed("bytes", "own"), ["doc", "ahead", "at"])
    met = met.join(found.toDF("other", "ahead", "other_at", "theirs"), ["other", "ahead", "other_at"])

    def run(batches):
        for batch in batches:
            sides_ = [batch.column(c).to_pylist() for c in ("own", "theirs", "ahead", "span")]
            got = [_matched(a[:n] if f else a[max(len(a) - n, 0):], b, f) for a, b, f, n in zip(*sides_)]
            counts = [pa.array([g[k] for g in got], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in [*keys, "ahead"]], *counts], [*keys, "ahead", "more", "more_words"])

    schema = "doc bigint, other bigint, shift int, start int, end int, word int, last_word int, ahead boolean, more int, more_words int"
    sized_ = met.select(*keys, "ahead", "span", "own", "theirs").mapInArrow(run, schema).groupBy(*keys)
    # If rows share a document, what all of them bear out.
    of = lambda ahead, value: F.coalesce(F.min(F.when(F.col("ahead") == ahead, F.col(value))), F.lit(0))
    sized_ = sized_.agg(of(False, "more").alias("left"), of(False, "more_words").alias("left_words"),
                        of(True, "more").alias("right"), of(True, "more_words").alias("right_words"))
    return sized_.select(
        "doc", F.least("doc", "other").alias("first_doc"), (F.col("start") - F.col("left")).alias("start"),
        (F.col("end") + F.col("right")).alias("end"), (F.col("word") - F.col("left_words")).alias("word"),
        (F.col("last_word") + F.col("right_words")).alias("last_word"))


def _passages(pieces: list[tuple[int, int, int, int, int]], min_words: int) -> list[tuple[int, int, int, int]]:
    """``start, end, words, first_doc`` from pieces ``start, end, word, last_word, first_doc``
    of a document: every byte goes to the smallest first_doc that has it."""
    word = {}
    for start, end, w, last, _ in pieces:
        word[start], word[end] = w, last
    opening = sorted(pieces)
    out, stretch, open_, at = [], [], [], 0
    places = sorted(word)
    for here, after in zip(places, places[1:] + [None]):
        while at < len(opening) and opening[at][0] == here:
            heappush(open_, (opening[at][4], opening[at][1]))
            at += 1
        while open_ and open_[0][1] <= here:
            heappop(open_)
        if open_:
            holder = open_[0][0]
            if stretch and stretch[-1][2] == holder:
                stretch[-1][1] = after
            else:
                stretch.append([here, after, holder])
        elif stretch:
            if word[stretch[-1][1]] - word[stretch[0][0]] >= min_words:
                out += [(a, b, word[b] - word[a], h) for a, b, h in stretch]
            stretch = []
    return out


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc, start, end, words, first_doc`` of every passage that other documents
    have as well; ``first_doc`` is the smallest document found to have it."""
    pieces = _extended(stored(_pieces(docs), "pieces"), docs)
    of_doc = pieces.groupBy("doc").agg(F.collect_list(F.struct("start", "end", "word", "last_word", "first_doc")).alias("pieces"))

    def run(batches):
        for batch in batches:
            rows = [(doc, *p) for doc, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for p in _passages([tuple(x.values()) for x in own], min_words)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                                             ["doc", "start", "end", "words", "first_doc"])

    return of_doc.mapInArrow(run, "doc bigint, start int, end int, words bigint, first_doc bigint")


def documents_with_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document that shares a passage with another one.

    ``passages`` lists where they are (bytes), their words, and the first document
    with each; ``removable`` counts the bytes that dropping all but the first saves.
    """
    found = repeated_passages(docs, min_words)
    later = F.col("first_doc") < F.col("doc")
    return found.groupBy(F.col("doc").alias("doc_id")).agg(
        F.count("*").alias("n_passages"), F.sum("words").alias("repeated_words"),
        F.sum(F.when(later, F.col("end") - F.col("start")).otherwise(0)).alias("removable"),
        F.sort_array(F.collect_list(F.struct("start", "end", "words", "first_doc"))).alias("passages"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with every passage removed that an earlier document has."""
    of, passages = own_names("doc", "passages")
    found = documents_with_repeats(docs, min_words).select(F.col("doc_id").alias(of), F.col("passages").alias(passages))
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text"))
    data = F.col("text").cast("binary")
    later = F.filter(passages, lambda p: p["first_doc"] < F.col(of))
    # What stands between the removed passages, from the end of one to the start of the next.
    starts = F.concat(F.array(F.lit(0)), F.transform(later, lambda p: p["end"]))
    ends = F.concat(F.transform(later, lambda p: p["start"]), F.array(F.length(data)))
    kept = F.transform(F.arrays_zip(starts.alias("from"), ends.alias("to")),
                       lambda s: F.decode(F.substring(data, s["from"] + 1, s["to"] - s["from"]), "utf-8"))
    joined = docs.join(found, doc == F.col(of), "left")
    cut = F.when(F.col(passages).isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    return joined.withColumn("text", cut).select(*docs.columns)
