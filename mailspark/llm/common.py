"""Small helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A key list is broadcast up to this many 64-bit keys (32 MB); beyond, it is joined.
BROADCAST_KEYS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_names(*names: str) -> list[str]:
    """Column names that no table has, for joins with tables of any columns."""
    ending = uuid.uuid4().hex
    return [f"_{name}_{ending}" for name in names]


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_KEYS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; stops counting beyond."""
    return df.limit(rows + 1).count() <= rows


def sized(df: DataFrame, rows: int = BROADCAST_KEYS) -> DataFrame:
    """``df`` marked for broadcast if it was counted and found small."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df


def groups_in_order(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by integer ``keys``.

    Only one group and one batch are in memory at a time.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for values in columns:
            change[1:] |= values[1:] != values[:-1]
        first = tuple(values[0] for values in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = np.flatnonzero(change)
        at = 0
        for cut in cuts:
            held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
        last = tuple(values[-1] for values in columns)
    if held:
        yield pa.Table.from_batches(held)


def in_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by ``keys`` and sorted by them, for ``groups_in_order``."""
    return df.repartition(*keys).sortWithinPartitions(*keys)
