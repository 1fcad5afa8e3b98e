"""Chunks of texts that are spread over several rows.

A text too large for one row comes as ordered segments. Its chunks are those of the
whole text: at the separator the segments were cut at, pieces are packed in order, as
many as fit a chunk, and only what is longer is split further. Where a pack starts
depends on all packs before it, but only through one number, the length of the
open pack. So every segment first says, on its own, how it would go on for any such
number; then a pass over these narrow rows finds the true one for each segment;
and then every segment packs on its own. Packs that cross segments meet by their
number, and none is longer than a chunk or one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailspark.operators.chunking import chunk_text
from mailspark.operators.skew import sums_by_range
from mailspark.session import stored


def _starts(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the pieces, and for every piece the next one that starts a pack if
    it does."""
    ends = np.cumsum(lengths)
    before = ends - lengths
    following = np.maximum(np.searchsorted(ends, before + size, side="right"), np.arange(len(lengths)) + 1)
    return ends, following


def _first_start(ends: np.ndarray, open_: int, size: int) -> int:
    """The first piece that does not fit the open pack; 0 if no pack is open."""
    return 0 if open_ < 0 else int(np.searchsorted(ends, size - open_, side="right"))


def _pieces(text: str, mark: str, leading: bool) -> list[str]:
    """Pieces of a segment, each with the mark ahead; ``leading`` says that the mark
    before the first piece was left at the end of the segment before."""
    parts = text.split(mark)
    return [(mark if leading or k else "") + part for k, part in enumerate(parts)]


class Layout:
    """How segments of a text join.

    ``mark`` is the separator they were cut at. With ``head`` and ``tail``, the
    first segment starts with the one and the last ends with the other, and each but
    the last ends with the mark; without, segments are joined by the mark. ``above``
    is the part of the tail that a separator of a higher level splits off.
    """

    def __init__(self, mark: str, head: str = "", tail: str = "", above: str = ""):
        self.mark, self.head, self.tail, self.above = mark, head, tail, above

    def split(self, segment: int, text: str) -> list[str]:
        if not self.head:
            return _pieces(text, self.mark, segment > 0)
        first, last = text.startswith(self.head), text.endswith(self.tail)
        text = text[:len(text) - len(self.above)] if last else text.removesuffix(self.mark)
        return _pieces(text, self.mark, not first)


def _facts(segments: DataFrame, size: int, layout: Layout) -> DataFrame:
    """Per segment: its characters and last-pack facts for every first start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"thread_id": [], "segment": [], "ends": [], "last": [], "left": [], "chars": []}
            for thread, segment, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                lengths = np.array([len(p) for p in layout.split(segment, text)], dtype=np.int64)
                ends, following = _starts(lengths, size)
                last = np.arange(len(lengths))
                for k in range(len(lengths) - 2, -1, -1):
                    if following[k] < len(lengths):
                        last[k] = last[following[k]]
                # Starts beyond the first ``size`` characters cannot be the first ones.
                window = min(len(lengths), int(np.searchsorted(ends, size, side="right")) + 1)
                out["thread_id"].append(thread)
                out["segment"].append(segment)
                out["ends"].append(ends[:window].tolist())
                out["last"].append(last[:window].tolist())
                out["left"].append((ends[-1] - (ends - lengths)[last[:window]]).tolist())
                out["chars"].append(int(ends[-1]))
            kinds = [batch.schema.field(0).type, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    schema = "thread_id string, segment bigint, ends array<bigint>, last array<bigint>, left array<bigint>, chars bigint"
    return segments.select("thread_id", "segment", "text").mapInArrow(run, schema)


def _entries(facts: DataFrame, size: int) -> DataFrame:
    """Per segment the open pack it begins with: its length and first piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thread, seen, open_, at = None, False, -1, (0, 0)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not seen or row["thread_id"] != thread:
                    thread, seen, open_, at = row["thread_id"], True, -1, (0, 0)
                out.append({"thread_id": thread, "segment": row["segment"], "open": open_, "pack_segment": at[0], "pack_no": at[1]})
                k = _first_start(np.array(row["ends"]), open_, size)
                if k < len(row["last"]):
                    open_, at = row["left"][k], (row["segment"], row["last"][k])
                else:
                    open_ += row["chars"]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("thread_id", pa.string()), ("segment", pa.int64()), ("open", pa.int64()), ("pack_segment", pa.int64()), ("pack_no", pa.int64())]))

    ordered = facts.repartition("thread_id").sortWithinPartitions("thread_id", "segment")
    return ordered.mapInArrow(run, "thread_id string, segment bigint, open bigint, pack_segment bigint, pack_no bigint")


def _packs(segments: DataFrame, entries: DataFrame, size: int, layout: Layout) -> DataFrame:
    """Parts of packs, numbered by the first piece of the pack."""
    names = ["thread_id", "pack_segment", "pack_no", "segment", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                pieces = layout.split(row["segment"], row["text"])
                ends, following = _starts(np.array([len(p) for p in pieces], dtype=np.int64), size)
                k = _first_start(ends, row["open"], size)
                if k:
                    out.append((row["thread_id"], row["pack_segment"], row["pack_no"], row["segment"], "".join(pieces[:k])))
                while k < len(pieces):
                    stop = int(following[k])
                    out.append((row["thread_id"], row["segment"], k, row["segment"], "".join(pieces[k:stop])))
                    k = stop
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names)

    same = F.col("thread_id").eqNullSafe(F.col("_thread")) & (F.col("segment") == F.col("_segment"))
    keyed = entries.withColumnsRenamed({"thread_id": "_thread", "segment": "_segment"})
    joined = segments.join(keyed, same).select("thread_id", "segment", "text", "open", "pack_segment", "pack_no")
    parts = joined.mapInArrow(run, "thread_id string, pack_segment bigint, pack_no bigint, segment bigint, text string")
    listed = F.array_sort(F.collect_list(F.struct("segment", "text")))
    whole = parts.groupBy("thread_id", "pack_segment", "pack_no").agg(listed.alias("parts"))
    return whole.select(
        "thread_id", "pack_segment", "pack_no", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def chunk_segments(
    segments: DataFrame, size: int, separators: tuple[str, ...], layout: Layout,
) -> DataFrame:
    """``(thread_id, chunk_no, text)``: the chunks that ``chunk_text`` would make of
    the joined segments ``(thread_id, segment, text)``, numbered from 0."""
    # What a segment says of itself is stored: the text is split again, not kept.
    facts = stored(_facts(segments, size, layout), "segments")
    packs = _packs(segments, _entries(facts, size), size, layout)
    if layout.above:
        # A text that fits as a whole keeps its tail; else the tail stands alone.
        totals = facts.groupBy(F.col("thread_id").alias("_thread")).agg(
            F.sum("chars").alias("total"), F.max("segment").alias("end"))
        whole = F.col("total") + len(layout.above) <= size
        packs = packs.join(totals.select("_thread", whole.alias("whole")), F.col("thread_id").eqNullSafe(F.col("_thread")))
        packs = packs.select(
            "thread_id", "pack_segment", "pack_no",
            F.when(F.col("whole"), F.concat("text", F.lit(layout.above))).otherwise(F.col("text")).alias("text"))
        alone = totals.where(~whole).select(
            F.col("_thread").alias("thread_id"), (F.col("end") + 1).alias("pack_segment"), F.lit(0).cast("bigint").alias("pack_no"),
            F.lit(layout.above).alias("text"))
        packs = packs.unionByName(alone)
    lower = separators[separators.index(layout.mark) + 1:]
    place = ["pack_segment", "pack_no"]
    # Texts are written once and cross once more; numbers are found on narrow rows.
    rows = stored(packs.select("thread_id", *place, chunk_text(F.col("text"), size, lower).alias("chunks")), "packs")
    counts = rows.select("thread_id", *place, F.size("chunks").cast("bigint").alias("number"))
    upto = sums_by_range(counts, "thread_id", place, {"upto": F.col("number")})
    first = upto.select(
        F.col("thread_id").alias("_thread"), F.col("pack_segment").alias("_segment"), F.col("pack_no").alias("_no"),
        (F.col("upto") - F.col("number")).alias("first"))
    same = F.col("thread_id").eqNullSafe(F.col("_thread")) & (F.col("pack_segment") == F.col("_segment")) & (F.col("pack_no") == F.col("_no"))
    numbered = rows.join(first, same).select("thread_id", "first", F.posexplode("chunks").alias("at", "text"))
    return numbered.select("thread_id", (F.col("first") + F.col("at")).alias("chunk_no"), "text")
