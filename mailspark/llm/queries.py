"""Registered queries: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.llm import language, toxicity
from mailspark.llm.chat import TOOLS, format_chat, tool_exchanges
from mailspark.llm.common import table
from mailspark.llm.decontamination import contaminated
from mailspark.llm.embeddings import embedding_duplicates
from mailspark.llm.hard_negatives import hard_negatives
from mailspark.llm.html_text import main_text
from mailspark.llm.lines import line_digests
from mailspark.llm.minhash import near_duplicates
from mailspark.llm.mixing import mixed_sizes
from mailspark.llm.repair import damaged, repair_report
from mailspark.llm.sharding import shard_documents
from mailspark.llm.substrings import documents_with_repeats


def long_texts(spark: SparkSession) -> None:
    """Arrow batches of a thousand rows: a batch of whole documents is large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_texts(spark)
    return documents_with_repeats(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 8)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_texts(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), width=2).drop("mark")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_texts(spark)
    return main_text(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(tool_exchanges(table(spark, sf_dir, "conversations")), TOOLS)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_texts(spark)
    documents = table(spark, sf_dir, "documents")
    return toxicity.score_documents(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_texts(spark)
    documents = table(spark, sf_dir, "documents")
    return language.identify(documents, language.fit(documents))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_texts(spark)
    return line_digests(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair_report(damaged(conversations), conversations)


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_decontamination": op7_decontamination,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_line_dedup": op12_line_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}
