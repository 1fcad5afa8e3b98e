"""Mbox archives as a splittable Spark source."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark.config import MailConfig
from mailspark.operators.skew import running_sums
from mailspark.session import checkpointed
from mailspark.sources.headers import Source, header_id
from mailspark.sources.messages import parse_mail, parse_messages

# A message starts at every line that begins with this; the reader consumes it.
LINE_SEPARATOR = "\nFrom "
ENVELOPE = b"From "

_SCHEMA = T.StructType([T.StructField("value", T.StringType())])


_RECORD = "path string, block bigint, row bigint, file_size bigint, is_first boolean, value binary"


def _records(lines: DataFrame) -> DataFrame:
    """Records with their place: file, block, and number within the block.

    The scan also marks the first record of each file, which is the one a block at
    offset 0 starts with. Nothing after the scan depends on the order of rows.
    """
    scanned = lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"), F.col("value").cast("binary").alias("value"),
    )

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One task reads a block, in its order.
        last, row = None, 0
        for batch in batches:
            first, rows = [], []
            for split in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist()):
                row = row + 1 if split == last else 0
                first.append(row == 0 and split[1] == 0)
                rows.append(row)
                last = split
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns["is_first"] = pa.array(first, pa.bool_())
            columns["row"] = pa.array(rows, pa.int64())
            names = ["path", "block", "row", "file_size", "is_first", "value"]
            yield pa.RecordBatch.from_arrays([columns[name] for name in names], names)

    return scanned.mapInArrow(mark, _RECORD)


def _lines(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).option("lineSep", LINE_SEPARATOR).text(list(paths))


def _literal(file: str) -> str:
    """A listed file as a path that names it alone: not encoded, its wildcards escaped."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(file))


def _first_records(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The first ``limit`` records in input order: file, block, place in it.

    Only as many files are read as hold them, twice as many on each try. Their records
    are counted per block in the JVM, and a prefix sum names the block in which the limit
    falls. The order of blocks decides on all others, so no message is sorted or joined.
    """
    files, taken = sorted(_lines(spark, path).inputFiles()), 1
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    while True:
        # Counted and read as one set of files, since the borders of blocks depend on it.
        lines = _lines(spark, *map(_literal, files[:taken])) if files else _lines(spark, path)
        counts = checkpointed(lines.groupBy(*place).agg(F.count("*").alias("n")))
        found = counts.agg(F.sum("n")).first()[0] or 0
        if found >= limit or taken >= len(files):
            break
        taken = min(2 * taken, len(files))
    records = _records(lines)
    if found <= limit:
        return records
    sums = running_sums(
        counts.withColumn("all", F.lit(0)), "all", ["path", "block"], {"upto": F.col("n")}, MailConfig.heavy_rows, MailConfig.small_keys)
    border = sums.where(F.col("upto") > limit).orderBy("path", "block").first()
    room = limit - border["upto"] + border["n"]
    end = F.struct(F.lit(border["path"]), F.lit(border["block"]).cast("bigint"), F.lit(room).cast("bigint"))
    return records.where(F.struct("path", "block", "row") < end)


def read_mbox(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Raw records of mbox files with the file and place they come from.

    ``limit`` takes the first records in input order, before any filter.
    """
    return _records(_lines(spark, path)) if limit is None else _first_records(spark, path, limit)


def stream_mbox(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The same records from files as they arrive in a folder."""
    lines = (
        spark.readStream.schema(_SCHEMA).option("lineSep", LINE_SEPARATOR)
        .option("maxFilesPerTrigger", files_per_batch).text(folder)
    )
    return _records(lines)


def _parse_record(record: dict) -> dict | None:
    value = record["value"]
    if not record["is_first"]:
        return parse_mail(ENVELOPE + value)
    # Bytes before a file's first separator are no message, unless the file has no
    # separator at all.
    if value.startswith(ENVELOPE) or len(value) >= record["file_size"] - 1:
        return parse_mail(value)
    return None


def parse_mbox(records: DataFrame) -> DataFrame:
    """Parsed messages of records, with their ``input_order``: file, block and
    place within it, which is the order of the messages in the file."""
    placed = records.select(F.struct("path", "block", "row").alias("input_order"), "file_size", "is_first", "value")
    return parse_messages(placed, ("value",), lambda: _parse_record, ("input_order",))


def scan_mbox(records: DataFrame) -> DataFrame:
    """``input_order`` and, where the headers leave no doubt, ``message_id`` of records,
    without parsing a message."""
    text = F.col("value").cast("string")
    # The first record of a file has its envelope line whole, or is no plain message.
    odd = F.col("is_first") & ~text.startswith(ENVELOPE.decode())
    return records.select(F.struct("path", "block", "row").alias("input_order"), F.when(~odd, header_id(text)).alias("message_id"))


MBOX = Source(scan_mbox, parse_mbox, ("path", "block", "row"))


def render_mbox(emails: DataFrame) -> DataFrame:
    """Emails as mbox text, one message per row, for ``df.write.text``.

    Lines that would start a new message are escaped, as mail programs do.
    """
    def header(name: str, value) -> object:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\n"))).otherwise("")

    stamp = F.date_format("date", "EEE MMM dd HH:mm:ss yyyy")
    return emails.select(F.concat(
        F.lit("From "), F.col("sender"), F.lit(" "), stamp, F.lit("\n"),
        header("Message-ID", F.col("id")), header("In-Reply-To", F.col("in_reply_to")),
        header("References", F.nullif(F.array_join("references", " "), F.lit(""))),
        header("Date", F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss '+0000'")),
        header("From", F.col("sender")), header("To", F.array_join("recipients", ", ")),
        header("Subject", F.col("subject")),
        F.lit("MIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"),
        F.regexp_replace("body", "(?m)^From ", ">From "), F.lit("\n"),
    ).alias("value"))
