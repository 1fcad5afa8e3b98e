"""Which message ids a store holds, at a cost that does not grow with the store.

Ids lie in runs. A run is a folder with one part per hash bucket, sorted by id, so a
batch opens only the parts that its own ids hash to. A small batch is a run of a single
part, which is always read. When ``fanout`` runs of a level have come together they are
folded into one run of the next level, so there are logarithmically many, and at most
``fanout`` of them are small.

A run of a batch counts once the batch is committed, a folded run once its row in the
``folds`` table is there, which also says what it covers. Covered runs stay for one more
fold, since a reader may be using them, and then go.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark.operators.skew import small_side
from mailspark.session import entries, read_table, remove_folder

BUCKETS = 1024
FANOUT = 8
SMALL_BATCH = 5000
# The part of a small batch, which belongs to no bucket.
_LOOSE = -1
_FOLDS = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("covers", T.ArrayType(T.StringType()))])


class IdIndex:
    """Runs of ids below a root folder; ``committed(writer, batch)`` says whether a
    batch counts."""

    def __init__(
        self, spark: SparkSession, root: str, committed: Callable[[str, int], bool], buckets: int = BUCKETS, fanout: int = FANOUT,
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.committed = committed
        self.buckets = buckets
        self.fanout = fanout

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def add(self, ids: DataFrame, writer: str, batch: int) -> None:
        """Writes the ids of a batch, before its commit."""
        small = ids.limit(SMALL_BATCH + 1).count() <= SMALL_BATCH
        self._write(ids, f"batch~{quote(writer, safe='')}~{batch}", small)

    def _write(self, ids: DataFrame, run: str, small: bool) -> None:
        rows = ids.select("id", (F.lit(_LOOSE) if small else self._bucket()).alias("part"))
        rows = rows.coalesce(1) if small else rows.hint("rebalance", "part")
        rows.sortWithinPartitions("part", "id").write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/runs/{run}")

    def _folds(self) -> list:
        return read_table(self.spark, f"{self.root}/folds", _FOLDS).collect()

    def runs(self) -> dict[str, int]:
        """Runs that count, with their level."""
        folds = self._folds()
        covered = {name for row in folds for name in row["covers"]}
        levels = {row["run"]: row["level"] for row in folds}
        live = {}
        for run in entries(self.spark, f"{self.root}/runs"):
            if run in covered:
                continue
            if run in levels:
                live[run] = levels[run]
            elif run.startswith("batch~"):
                _, writer, batch = run.split("~")
                if self.committed(unquote(writer), int(batch)):
                    live[run] = 0
        return live

    def _parts(self, runs: list[str], buckets: set[int] | None) -> list[str]:
        """Folders of runs, of the given buckets only."""
        out = []
        for run in runs:
            for name in entries(self.spark, f"{self.root}/runs/{run}"):
                if name.startswith("part=") and (buckets is None or int(name[5:]) in buckets):
                    out.append(f"{self.root}/runs/{run}/{name}")
        return out

    def _read(self, paths: list[str]) -> DataFrame:
        schema = T.StructType([T.StructField("id", T.StringType())])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def near(self, ids: DataFrame) -> DataFrame:
        """``(id)``: all stored ids in the buckets that ``ids`` fall into."""
        # At most one number per bucket.
        buckets = {r[0] for r in ids.select(self._bucket().alias("part")).distinct().collect()}
        return self._read(self._parts(list(self.runs()), buckets | {_LOOSE}))

    def known(self, ids: DataFrame, small: int = 20_000) -> DataFrame:
        """Those of ``ids (id)`` that are stored."""
        return self.near(ids).join(small_side(ids.select("id").distinct(), small), "id", "left_semi").distinct()

    def fold(self) -> None:
        """Folds every level that has ``fanout`` runs, and drops what earlier folds
        covered."""
        before = {name for row in self._folds() for name in row["covers"]}
        level = 0
        while True:
            runs = sorted(run for run, at in self.runs().items() if at == level)
            if len(runs) < self.fanout:
                break
            name = f"fold~{level + 1}~{uuid.uuid4().hex}"
            self._write(self._read(self._parts(runs, None)).distinct(), name, False)
            row = self.spark.createDataFrame([(name, level + 1, runs)], _FOLDS)
            row.coalesce(1).write.mode("append").parquet(f"{self.root}/folds")
            level += 1
        if level:
            for run in before & set(entries(self.spark, f"{self.root}/runs")):
                remove_folder(self.spark, f"{self.root}/runs/{run}")
