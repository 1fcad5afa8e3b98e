"""What a Python worker holds does not grow with the table."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailspark import session
from mailspark.operators.vector_index import SENT, VectorIndex
from mailspark.sources import mbox

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def conf(spark):
    before = spark.conf.get(LIMIT)
    yield spark.conf
    spark.conf.set(LIMIT, before)


def test_batches_of_mails_are_bounded_in_bytes(spark, conf):
    records = spark.range(0, 4000, numPartitions=1).select(
        F.lit("f").alias("path"), F.lit(0).cast("bigint").alias("block"), F.col("id").alias("row"),
        F.lit(1 << 40).alias("file_size"), F.lit(False).alias("is_first"),
        F.concat(F.lit("a Mon\nMessage-ID: "), F.col("id"), F.lit("\n\n"), F.repeat(F.lit("x"), 5000)).cast("binary").alias("value"))
    parsed = mbox.parse_mbox(records)
    assert parsed.where(F.length("plain") == 5000).select("message_id").distinct().count() == 4000

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    most = records.select("value").mapInArrow(sizes, "n bigint").agg(F.max("n")).first()[0]
    assert most * 5000 <= 2 * session.BATCH_BYTES


def test_a_lower_bound_of_the_session_stays(spark, conf):
    conf.set(LIMIT, "1000b")
    session.small_batches(spark)
    assert conf.get(LIMIT) == "1000b"


def test_questions_are_sent_in_small_batches(spark, conf, tmp_path):
    asked = spark.range(0, 1000, numPartitions=1).select(F.col("id").alias("question"), F.array(F.lit(1.0), F.col("id") * 1.0).alias("v"))

    def choose(unit, _):
        assert len(unit) <= SENT
        return np.arange(len(unit)), np.zeros(len(unit))

    sent = VectorIndex(spark, str(tmp_path))._sent(asked, 2, choose)
    assert sent.count() == 1000
