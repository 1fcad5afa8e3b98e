import random

from pyspark.sql import functions as F

from mailspark.operators import stats


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "text_block_len bigint")


def test_sketches_of_batches(spark, tmp_path):
    rng = random.Random(3)
    values = [int(rng.lognormvariate(8, 2)) for _ in range(40_000)] + [500] * 20_000
    rng.shuffle(values)
    sketches = stats.LengthSketches(spark, str(tmp_path / "s"))
    for batch in range(6):
        sketches.add(batch, frame(spark, values[batch::6]))
    sketches.add(4, frame(spark, values[4::6]))
    sketches.add(9, frame(spark, []))
    sketches.add(10, frame(spark, [None]))
    lengths = frame(spark, values)
    found, exact = sketches.read(), stats.length_stats(lengths)
    assert found.columns == exact.columns
    got, want = found.first(), exact.first()
    for name in ("threads", "mean", "min", "max", "stddev"):
        assert got[name] == want[name]
    errors = stats.rank_errors(lengths, found).first()
    assert all(errors[name] < stats.RANK_ERROR for name in stats.PERCENTILES)
    # What is stored does not grow with the rows.
    assert spark.read.parquet(sketches.path).agg(F.max(F.length("sketch"))).first()[0] < 50_000
    # A value far from its rank is seen.
    far = found.withColumn("p90", F.col("median"))
    assert stats.rank_errors(lengths, far).first()["p90"] > 0.1


def test_sketches_without_rows(spark, tmp_path):
    sketches = stats.LengthSketches(spark, str(tmp_path / "s"))
    sketches.add(0, frame(spark, []))
    got = sketches.read().first()
    assert got["threads"] == 0 and got["median"] is None and got["mean"] is None
