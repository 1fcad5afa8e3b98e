"""Ranking and filtering that do not depend on how rows spread over keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailspark.session import checkpointed


def small_keys(df: DataFrame, name: str, limit: int) -> tuple[DataFrame | None, int]:
    """The keys as a local table to broadcast and their number; no table if there
    are more than ``limit``."""
    found = df.select(name).limit(limit + 1).collect()
    if len(found) > limit:
        return None, len(found)
    return df.sparkSession.createDataFrame(found, df.select(name).schema), len(found)


def small_side(df: DataFrame, limit: int) -> DataFrame:
    """``df`` marked for broadcast if it was counted and has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


class KeySet:
    """A set of keys, broadcast only when it was counted and found small."""

    def __init__(self, keys: DataFrame, name: str, limit: int):
        self.name = name
        local, number = small_keys(keys, name, limit)
        self.empty = number == 0
        self.frame = checkpointed(keys.select(name)) if local is None else F.broadcast(local)

    def _matched(self, df: DataFrame, how: str) -> DataFrame:
        keys = self.frame.withColumnRenamed(self.name, "_key")
        return df.join(keys, F.col(self.name).eqNullSafe(F.col("_key")), how)

    def inside(self, df: DataFrame) -> DataFrame:
        return df.limit(0) if self.empty else self._matched(df, "left_semi")

    def outside(self, df: DataFrame) -> DataFrame:
        return df if self.empty else self._matched(df, "left_anti")


def heavy_keys(df: DataFrame, key: str, weight: Column, limit: int, small: int) -> KeySet:
    """Keys whose rows weigh more than ``limit`` together.

    There are at most (total weight / limit) of them. The sum is combined before
    the shuffle, so a hot key costs one row per map task.
    """
    heavy = df.groupBy(key).agg(F.sum(weight).alias("_weight")).where(F.col("_weight") > limit)
    return KeySet(heavy, key, small)


def sums_in_task(df: DataFrame, key: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Running sums per key, for keys that fit a task."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *[F.sum(value).over(upto).alias(name) for name, value in sums.items()])


def sums_by_range(df: DataFrame, key: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Running sums per key, with each key cut into ordered slices.

    Rows are range-partitioned on key and order, so a key that fills a third of
    the table spans a third of the tasks. Each slice sums on its own and adds
    what the slices before it came to. The slice numbers are written down first:
    a second evaluation could draw other range bounds.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = checkpointed(
        df.repartitionByRange(slices, key, *order).withColumn("_slice", F.spark_partition_id())
    )
    totals = sliced.groupBy(key, "_slice").agg(*[F.sum(value).alias(f"_{name}") for name, value in sums.items()])
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col(key).alias("_key"), F.col("_slice").alias("_at"),
        *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums],
    )
    upto = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(value).over(upto).alias(name) for name, value in sums.items()])
    joined = local.join(totals, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_at")))
    return joined.select(
        *df.columns, *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in sums]
    )


def running_sums(
    df: DataFrame, key: str, order: list[str], sums: dict[str, Column], heavy_rows: int, small: int,
) -> DataFrame:
    """Running sums in order within each key; ``{"n": lit(1)}`` gives positions."""
    heavy = heavy_keys(df, key, F.lit(1), heavy_rows, small)
    light = sums_in_task(heavy.outside(df), key, order, sums)
    if heavy.empty:
        return light
    return light.unionByName(sums_by_range(heavy.inside(df), key, order, sums))
