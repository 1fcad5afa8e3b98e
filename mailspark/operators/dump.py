"""Thread dumps: metadata, document and summary as readable text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.functions.text import indent_block

# The layout of a dump entry.
HEADER = (
    "============================================\n"
    "=============== Email Thread ===============\n"
    "============================================\n\n"
)
_LENGTH = r'"text_block_len":\s*(\d+)'


def dump_entries(threads: DataFrame) -> DataFrame:
    """One text entry per row of ``(metadata, text, summary)``; a row without
    metadata goes on with the entry before it."""
    fields = threads.schema["metadata"].dataType.names

    def value(name):
        # Through a one-field struct, since to_json takes no bare values.
        wrapped = F.to_json(F.struct(F.col(f"metadata.{name}").alias("v")), {"ignoreNullFields": "false"})
        return F.concat(F.lit(f'    "{name}": '), F.regexp_extract(wrapped, r'(?s)^\{"v":(.*)\}$', 1))

    metadata = F.concat(F.lit("{\n"), F.concat_ws(",\n", *[value(name) for name in fields]), F.lit("\n}"))
    summary = F.when(
        F.coalesce("summary", F.lit("")) != "",
        F.concat(F.lit("Text Block Summarized:\n\n"), indent_block(F.col("summary")), F.lit("\n\n")),
    ).otherwise("")
    head = F.when(F.col("metadata").isNull(), "").otherwise(F.concat(F.lit(HEADER + "METADATA:\n"), metadata, F.lit("\n\n")))
    return threads.select(F.concat(
        head, indent_block(F.coalesce("text", F.lit(""))), F.lit("\n\n"), summary,
    ).alias("value"))


def write_dump(threads: DataFrame, path: str) -> None:
    """Writes a dump folder; a repeated run replaces it. The segments of a large
    thread are kept in order, if need be across files."""
    if {"thread_id", "segment"} <= set(threads.columns):
        threads = threads.repartitionByRange("thread_id", "segment").sortWithinPartitions("thread_id", "segment")
    dump_entries(threads).write.mode("overwrite").text(path)


def read_dump_lengths(spark: SparkSession, path: str) -> DataFrame:
    """The document lengths recorded in dump files."""
    lines = spark.read.text(path).where(F.col("value").rlike(_LENGTH))
    return lines.select(F.regexp_extract("value", _LENGTH, 1).cast("bigint").alias("text_block_len"))
