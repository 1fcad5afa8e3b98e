"""Line deduplication by levelled sorted runs of line hashes.

``LineRuns`` remembers which lines have been seen. A run is a table of 128-bit line
hashes with the document that holds the line, bucketed and sorted by hash. A batch of
documents brings its lines down to one row per hash, merge-anti-joins them with the
runs, one after the other, and adds what is left as a run of level 0. All sides are
bucketed alike, so the batch is shuffled once for all runs and the runs not at all.
When a level holds ``FANOUT`` runs they are compacted into one run of the next level,
which leaves at most ``FANOUT`` runs a level and logarithmically many in all.

``repeated_lines`` takes the documents in batches from the largest doc_id down, so the
first batch that brings a line brings the document that keeps it. Only lines that occur
in ``min_docs`` documents, counted before, enter the runs; no other line can go.

A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z
lower-cased. Lines are told apart by 128 bits of their key.

Cases: a null or empty text is one empty line. Rows with one doc_id are one document;
rows without doc_id are one document together, smaller than all others. Lines of a
document that repeat go or stay together. Empty tables give empty results. Columns other
than doc_id and text are not read. A line that fills a third of the table is one row per
task before any shuffle of keys, and the split side of a join with unique keys after it.
"""

from __future__ import annotations

import uuid
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.llm.common import sized
from mailspark.session import checkpointed, scratch_path, stored

MIN_DOCS = 5
MIN_CHARS = 40
BATCHES = 8
FANOUT = 4
# A list of line hashes is broadcast up to this many rows (some 50 MB).
BROADCAST_LINES = 500_000
# White space that is stripped: space and the ASCII controls from tab to return.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASH = ["h0", "h1"]


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, mark, place, h0, h1`` of every line whose key has ``min_chars`` code
    points. ``mark`` is a hash of the text: rows that share a doc_id may differ in it."""
    placed = docs.select(
        F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("mark"),
        F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    keyed = placed.where(F.length(F.trim("line", F.lit(BLANKS))) >= min_chars)
    keyed = keyed.select("doc_id", "mark", "place", line_key(F.col("line")).alias("key"))
    return keyed.select(
        "doc_id", "mark", "place", F.xxhash64("key").alias("h0"), F.xxhash64(F.lit("line"), "key").alias("h1"))


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``h0, h1`` of the lines that occur in at least ``min_docs`` documents."""
    apart = lines.groupBy(*_HASH, "doc_id").agg(F.lit(1).alias("one"))
    return apart.groupBy(*_HASH).agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select(*_HASH)


class LineRuns:
    """Sorted runs of seen lines ``(h0, h1, doc_id)`` in levels.

    The runs are bucketed tables below the shared folder, so that neither a lost
    executor nor a lost shuffle file takes one away. ``drop`` forgets them.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark = spark
        self.fanout = fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._own: list[str] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, *_HASH)
        path = scratch_path(self.spark, "line-run")
        dealt.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", path).saveAsTable(name)
        self._own.append(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _union(self, names: list[str]) -> DataFrame:
        tables = [self.spark.table(name) for name in names]
        out = tables[0]
        for other in tables[1:]:
            out = out.unionByName(other)
        return out

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Rows of ``lines (h0, h1, ...)`` that no run holds, run by run."""
        for name in self.runs():
            lines = lines.join(self.spark.table(name).hint("merge"), _HASH, "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """Takes a batch ``(h0, h1, doc_id)`` of occurrences: the lines not seen before
        become a run, each with the largest doc_id of the batch that holds it."""
        own = lines.groupBy(*_HASH).agg(F.max("doc_id").alias("doc_id"))
        self._write(self.unseen(own), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            # No line is in two runs, so compaction is a union in order.
            full, self.levels[level] = self.levels[level], []
            self._write(self._union(full), level + 1)
            level += 1

    def seen(self) -> DataFrame:
        """``h0, h1, doc_id``: every line with the document that brought it first."""
        names = self.runs()
        if not names:
            return self.spark.createDataFrame([], "h0 bigint, h1 bigint, doc_id bigint")
        return self._union(names)

    def drop(self) -> None:
        for name in self._own:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._own, self.levels = [], []


def _borders(lines: DataFrame, batches: int) -> list[int]:
    """Descending doc_ids that cut the lines into batches of about equal size. They decide
    how much a batch holds, not which lines go."""
    if batches < 2:
        return []
    parts = [i / batches for i in range(batches - 1, 0, -1)]
    found = lines.agg(F.percentile_approx("doc_id", parts).alias("cuts")).first()["cuts"]
    return sorted(set(found or []), reverse=True)


def repeated_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT,
) -> DataFrame:
    """``doc_id, mark, places``: the line numbers that go, for every text that loses any."""
    spark = docs.sparkSession
    lines = stored(long_lines(docs, min_chars), "lines")
    frequent = sized(stored(frequent_lines(lines, min_docs), "frequent"), BROADCAST_LINES)
    open_lines = stored(lines.join(frequent, _HASH, "left_semi"), "open-lines")
    runs = LineRuns(spark, fanout)
    above = None
    for border in [*_borders(open_lines, batches), None]:
        batch = open_lines
        if border is not None:
            batch = batch.where(F.col("doc_id") > border)
        if above is not None:
            inside = F.col("doc_id") <= above
            # The last batch takes rows without doc_id as well.
            batch = batch.where(inside | F.col("doc_id").isNull() if border is None else inside)
        runs.add(batch.select(*_HASH, "doc_id"))
        above = border
    keepers = runs.seen().select(*_HASH, F.col("doc_id").alias("keeper"))
    goes = open_lines.join(sized(keepers, BROADCAST_LINES), _HASH).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    out = checkpointed(goes.groupBy("doc_id", "mark").agg(F.collect_set("place").alias("places")))
    runs.drop()
    return out


def _joined(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` with ``places``, the line numbers that go or null."""
    marked = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("mark"))
    goes = sized(repeated.select(F.col("doc_id").alias("of_doc"), F.col("mark").alias("of_mark"), "places"), BROADCAST_LINES // 4)
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("mark") == F.col("of_mark"))
    return marked.join(goes, same, "left").select("doc_id", "text", "places")


def _kept(text: str | None, places: list[int] | None) -> tuple[int, str]:
    """Number of lines, and those that stay, joined."""
    if not places:
        return (text or "").count("\n") + 1, text or ""
    lines, goes = text.split("\n"), set(places)
    return len(lines), "\n".join(line for i, line in enumerate(lines) if i not in goes)


def _rewritten(docs: DataFrame, last: str, value, options: dict) -> DataFrame:
    """``doc_id, n_lines, n_dropped`` and, as ``last``, a value of the text that stays."""
    names = ["doc_id", "n_lines", "n_dropped", last]

    def run(batches):
        for batch in batches:
            places = batch.column(2).to_pylist()
            kept = [_kept(text.as_py(), gone) for text, gone in zip(batch.column(1), places)]
            columns = [
                batch.column(0), pa.array([n for n, _ in kept], pa.int64()),
                pa.array([len(gone or ()) for gone in places], pa.int64()), pa.array([value(text) for _, text in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id bigint, n_lines bigint, n_dropped bigint, {last} string"
    return _joined(docs, repeated_lines(docs, **options)).mapInArrow(run, schema)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text``: every document without its repeated lines."""
    return _rewritten(docs, "text", lambda text: text, options)


def line_digests(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256``: the same with a digest of the text."""
    return _rewritten(docs, "kept_sha256", lambda text: sha256(text.encode()).hexdigest(), options)
