"""Embedding models: a dimension table of fixed size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.config import CHARS_PER_TOKEN, MailConfig

# Model, kind, vector size, maximum tokens.
MODELS = (
    ("all-MiniLM-L6-v2", "MiniLM", 384, 512),
    ("all-MiniLM-L12-v2", "MiniLM", 384, 512),
    ("bge-base-en-v1.5", "BERT", 768, 512),
    ("bge-large-en-v1.5", "BERT", 1024, 512),
    ("mxbai-embed-large", "BERT", 1024, 512),
    ("e5-base-v2", "BERT", 768, 512),
    ("e5-large-v2", "BERT", 1024, 512),
    ("bge-m3", "BERT", 1024, 8192),
    ("nomic-embed-text", "Custom", 768, 8192),
)


def char_budget(tokens: Column) -> Column:
    return F.floor(tokens * F.lit(CHARS_PER_TOKEN)).cast("int")


def model_catalog(spark: SparkSession) -> DataFrame:
    models = spark.createDataFrame(MODELS, "model string, kind string, dim int, max_tokens int")
    return models.withColumn("max_chars", char_budget(F.col("max_tokens")))


def model(name: str) -> tuple:
    for row in MODELS:
        if row[0] == name:
            return row
    raise ValueError(f"unknown embedding model {name!r}")


def chunk_chars(cfg: MailConfig) -> int:
    """The chunk size in characters: the given one, else what the model takes."""
    return cfg.chunk_size or math.floor(model(cfg.embed_model)[3] * CHARS_PER_TOKEN)


def context_chars(cfg: MailConfig) -> int:
    return math.floor(cfg.context_tokens * CHARS_PER_TOKEN)
