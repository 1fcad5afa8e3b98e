"""Length statistics of threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.session import stored

BINS = 80
PERCENTILES = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
# A sketch of this size misses the rank of a quantile by less than RANK_ERROR: the
# error it states for 99 % of all cases is 0.0044.
SKETCH_SIZE = 1024
RANK_ERROR = 0.01


def _counts(lengths: DataFrame, column: str) -> DataFrame:
    # As many rows as there are different lengths, whatever the table's size.
    return lengths.groupBy(F.col(column).cast("bigint").alias("length")).agg(F.count("*").alias("n"))


def _deviation(n: Column, total: Column, squares: Column) -> Column:
    spread = squares / n - (total.cast("decimal(38,0)") / n) * (total.cast("double") / n)
    return F.sqrt(F.greatest(F.lit(0.0), spread.cast("double")))


def length_stats(lengths: DataFrame, column: str = "text_block_len") -> DataFrame:
    """Count, mean, median, population deviation, extremes and percentiles."""
    counts = _counts(lengths, column)

    def exact(share: float):
        return F.percentile("length", share, F.col("n"))

    n = F.sum("n")
    total = F.sum(F.col("length") * F.col("n"))
    # Squares as decimals: exact, so the two sums may be subtracted.
    squares = F.sum(F.col("length").cast("decimal(19,0)") * F.col("length") * F.col("n"))
    return counts.agg(
        n.alias("threads"), (total / n).alias("mean"), exact(0.5).alias("median"),
        F.min("length").alias("min"), F.max("length").alias("max"),
        exact(0.9).alias("p90"), exact(0.95).alias("p95"), exact(0.99).alias("p99"),
        _deviation(n, total, squares).alias("stddev"),
    )


def length_histogram(lengths: DataFrame, column: str = "text_block_len", bins: int = BINS) -> DataFrame:
    """Equal-width bins of the lengths up to the 95th percentile; the last bin is
    closed. Bins without threads are left out.

    The counts per length are stored, since the bounds need them before the bins.
    """
    counts = stored(_counts(lengths, column), "lengths")
    p95 = counts.agg(F.percentile("length", 0.95, F.col("n"))).scalar()
    kept = counts.where(F.col("length") <= p95)
    low, high = kept.agg(F.min("length")).scalar(), kept.agg(F.max("length")).scalar()
    width = (high - low) / F.lit(float(bins))
    slot = F.when(width > 0, F.least(F.floor((F.col("length") - low) / width), F.lit(bins - 1))).otherwise(bins // 2)
    return kept.withColumn("bin", slot.cast("bigint")).groupBy("bin").agg(F.sum("n").alias("threads"))


class LengthSketches:
    """Length statistics of a growing table: one row of sums and a quantile sketch per
    batch, merged on reading, so that no earlier row is read again.

    Batches hold different rows. One that is added again replaces itself. Count, mean,
    deviation and extremes are exact; the rank of a percentile is right within
    ``RANK_ERROR``. ``length_stats`` is the exact way over the whole table.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, batch: int, lengths: DataFrame, column: str = "text_block_len") -> None:
        value = F.col(column).cast("bigint")
        # A task sends one sketch, whatever the number of its rows.
        row = lengths.agg(
            F.count(value).alias("threads"), F.sum(value).alias("total"),
            F.sum(value.cast("decimal(19,0)") * value).cast("decimal(38,0)").alias("squares"),
            F.min(value).alias("min"), F.max(value).alias("max"),
            F.kll_sketch_agg_bigint(value, F.lit(SKETCH_SIZE)).alias("sketch"))
        row.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self) -> DataFrame:
        """One row with the columns of ``length_stats``."""
        merged = self.spark.read.parquet(self.path).where("threads > 0").agg(
            F.sum("threads").alias("threads"), F.sum("total").alias("total"),
            F.sum("squares").cast("decimal(38,0)").alias("squares"), F.min("min").alias("min"), F.max("max").alias("max"),
            F.kll_merge_agg_bigint("sketch").alias("sketch"))
        n, total = F.col("threads"), F.col("total")
        at = {
            name: F.when(n > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(share))).alias(name)
            for name, share in PERCENTILES.items()}
        return merged.select(
            F.coalesce(n, F.lit(0)).cast("bigint").alias("threads"), (total / n).alias("mean"), at["median"], "min", "max",
            at["p90"], at["p95"], at["p99"], _deviation(n, total, F.col("squares")).alias("stddev"))


def rank_errors(lengths: DataFrame, found: DataFrame, column: str = "text_block_len") -> DataFrame:
    """How far each percentile of ``found``, one row, is from its rank in ``lengths``."""
    values = found.select(*[F.col(name).alias(f"_{name}") for name in PERCENTILES]).first()
    length, errors = F.col("length"), []
    counts = _counts(lengths, column)
    for name, share in PERCENTILES.items():
        value = F.lit(values[f"_{name}"])
        below = F.sum(F.when(length < value, F.col("n")).otherwise(0)) / F.sum("n")
        upto = F.sum(F.when(length <= value, F.col("n")).otherwise(0)) / F.sum("n")
        # Equal lengths share a range of ranks.
        errors.append(F.greatest(F.lit(0.0), below - share, F.lit(share) - upto).alias(name))
    return counts.agg(*errors)
