"""A landing zone of mail-API message resources, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark.sources.headers import Source
from mailspark.sources.messages import parse_messages, parse_resource

INBOX = "INBOX"

# The flat part of a resource; the recursive part stays raw until it is parsed.
_ENVELOPE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("threadId", T.StringType()),
    T.StructField("labelIds", T.ArrayType(T.StringType())),
    T.StructField("internalDate", T.StringType()),
    T.StructField("payload", T.StructType([
        T.StructField("headers", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()), T.StructField("value", T.StringType()),
        ]))),
    ])),
])


def header_map(headers: Column) -> Column:
    """Header list to a map by lower-case name; the last duplicate wins."""
    named = F.transform(headers, lambda h: F.struct(F.lower(h["name"]).alias("key"), h["value"].alias("value")))
    # Built from the reversed list with the first of each name kept, so the
    # result does not depend on the session's duplicate-key policy.
    backwards = F.reverse(named)
    names = F.transform(backwards, lambda e: e["key"])
    last = F.filter(backwards, lambda e, i: F.array_position(names, e["key"]) == i + 1)
    return F.map_from_entries(last)


def _envelope(lines: DataFrame) -> DataFrame:
    parsed = lines.select(F.col("value").alias("raw"), F.from_json("value", _ENVELOPE).alias("m"))
    return parsed.select(
        F.col("m.id").alias("resource_id"), F.col("m.threadId").alias("thread_id"),
        F.coalesce("m.labelIds", F.array().cast("array<string>")).alias("label_ids"),
        F.coalesce(F.col("m.internalDate").try_cast("bigint"), F.lit(0).cast("bigint")).alias("internal_date"),
        header_map(F.coalesce("m.payload.headers", F.array().cast(_ENVELOPE["payload"].dataType["headers"].dataType))).alias("headers"),
        "raw",
    )


def read_resources(spark: SparkSession, path: str) -> DataFrame:
    return _envelope(spark.read.text(path))


def stream_resources(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return _envelope(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder))


def since(resources: DataFrame, mark_ms: int | Column | None) -> DataFrame:
    """Resources newer than a mark in milliseconds since the epoch."""
    return resources if mark_ms is None else resources.where(F.col("internal_date") > mark_ms)


def inbox(resources: DataFrame, mark_ms: int | Column | None = None, newest: int | None = None) -> DataFrame:
    """Inbox mail after the mark; ``newest`` keeps the latest n of the listing."""
    listed = resources.where(F.array_contains("label_ids", INBOX))
    if newest is not None:
        listed = listed.orderBy(F.desc("internal_date"), F.desc("resource_id")).limit(newest)
    return since(listed, mark_ms)


def _parser():
    return lambda record: parse_resource(record["raw"])


def parse_resources(resources: DataFrame) -> DataFrame:
    """Parsed messages. One without a Message-ID gets a hash of its content, so
    reading it again gives the same row."""
    order = F.struct("internal_date", "resource_id").alias("input_order")
    prepared = resources.select(order, F.sha2("raw", 256).alias("raw_hash"), "raw")
    parsed = parse_messages(prepared, ("raw",), _parser, ("input_order", "raw_hash"))
    return parsed.withColumn("message_id", F.coalesce("message_id", "raw_hash")).drop("raw_hash")


def scan_resources(resources: DataFrame) -> DataFrame:
    """``input_order`` and ``message_id`` from the envelope alone."""
    named = F.coalesce(F.get(F.map_values(F.map_filter("headers", lambda k, _: k == "message-id")), 0), F.sha2("raw", 256))
    return resources.select(F.struct("internal_date", "resource_id").alias("input_order"), F.nullif(named, F.lit("")).alias("message_id"))


RESOURCES = Source(scan_resources, parse_resources, ("internal_date", "resource_id"))
