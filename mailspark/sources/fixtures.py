"""Mail tables derived from the driver's parquet tables.

Neighbouring turns are found by joins on ``(conv_id, turn)`` instead of windows
per conversation, so a conversation of any length spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT_DATE = "2024-01-01 08:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    link = F.concat(
        F.lit("\n\nsee https://example.org/p/"), conv.cast("string"), F.lit("?t="), turn.cast("string"),
        F.lit(" and www.example.com/x"),
    )
    base = F.concat(
        F.col("text"),
        F.when(conv % 5 == 0, link).otherwise(""),
        F.when((turn > 0) & (turn % 3 == 0), "\n\nOn Mon, someone wrote:\nzzzz").otherwise(""),
    )
    base = F.when((conv % 11 == 0) & (turn == 2), "").otherwise(base)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", base.alias("base"))


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    before = turns.where(F.col("turn") % 3 == 0).select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("base").alias("quoted"))
    last = (
        turns.groupBy("conv_id").agg(F.max("turn").alias("turn"))
        .select("conv_id", "turn", F.lit(True).alias("is_last"))
    )
    rows = turns.join(before, ["conv_id", "turn"], "left").join(last, ["conv_id", "turn"], "left")

    conv, turn = F.col("conv_id"), F.col("turn")

    def mail_id(number):
        return F.concat(F.lit("m"), conv.cast("string"), F.lit("-"), number.cast("string"))

    date = (
        F.to_timestamp_ntz(F.lit(ROOT_DATE))
        + F.make_dt_interval((conv % 28).cast("int"), turn.cast("int"))
    )
    return rows.select(
        mail_id(turn).alias("id"),
        mail_id(F.lit(0)).alias("thread_id"),
        F.concat(F.when(turn > 0, "Re: ").otherwise(" "), F.lit("topic "), conv.cast("string")).alias("subject"),
        F.when(turn > 0, F.transform(F.sequence(F.lit(0), turn - 1), mail_id))
        .otherwise(F.array().cast("array<string>")).alias("references"),
        F.when(turn > 0, mail_id(turn - 1)).alias("in_reply_to"),
        date.cast("timestamp_ntz").alias("date"),
        F.concat("role", (conv % 7).cast("string"), F.lit("@example.com")).alias("sender"),
        F.array(F.lit("list@example.com")).alias("recipients"),
        F.when(turn % 3 == 1, F.concat_ws("", "base", F.lit("\n\nOn Mon, someone wrote:\n"), "quoted"))
        .otherwise(F.col("base")).alias("body"),
        F.when(conv % 3 == 0, True).when(conv % 3 == 1, F.col("is_last").isNull()).otherwise(False)
        .alias("is_embedded"),
    )


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_conv = table(spark, sf_dir, "conversations").agg(F.max("conv_id") + 1).scalar()
    doc = F.col("doc_id")
    is_text = doc % 8 == 0
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.concat(F.lit("a"), doc.cast("string")).alias("id"),
        F.concat(F.lit("m"), (F.floor(doc / 4) % n_conv).cast("string"), F.lit("-0")).alias("email_id"),
        F.concat(F.lit("doc"), doc.cast("string"), F.when(is_text, ".TXT").otherwise(".csv")).alias("filename"),
        F.when(is_text, "text/plain").otherwise("text/csv").alias("mime_type"),
        F.when(is_text, ".txt").otherwise(".csv").alias("extension"),
        F.col("n_chars").cast("int").alias("size"),
        F.when(F.col("lang") != "es", F.col("text")).alias("text_content"),
    )
