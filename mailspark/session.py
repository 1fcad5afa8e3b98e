"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def local_session(app: str = "mailspark", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the local benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables.

    It is the one the session names. Only a local session without one gets a
    temporary folder; a cluster without one is an error, because executors do
    not share a machine-local path.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if not named:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="mailspark-")
        context.setCheckpointDir(named)
    return (named or context.getCheckpointDir()).rstrip("/")


_scope: ContextVar[str] = ContextVar("scope", default="")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/scratch/{_scope.get()}{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside go when the block ends, which must have written its
    results by then. Endless jobs run every batch in one."""
    token = _scope.set(f"{_scope.get()}run-{uuid.uuid4().hex}/")
    try:
        yield
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/scratch/{_scope.get()}")
        _scope.reset(token)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def entries(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder; none if it does not exist."""
    system, folder = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(folder)) if system.exists(folder) else []


def remove_folder(spark: SparkSession, path: str) -> None:
    system, folder = _file_system(spark, path)
    system.delete(folder, True)


# Bytes of rows that Python gets at once, where rows are whole mails, files or blocks.
BATCH_BYTES = 8 << 20


def _bytes(value: str, most: int) -> int:
    """A size as Spark writes it ("64m", "1000b", "1000") in bytes, at most ``most``."""
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", value.strip().lower()).groups()
    return min(most, int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[unit[:1]])


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by ``BATCH_BYTES``, unless the session has a lower bound.

    A worker holds a batch several times over (bytes, objects, results), so with the
    default its memory grows with the table until a task fills batches of 64 MB.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, f"{_bytes(spark.conf.get(name), BATCH_BYTES)}b")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a parquet table in the shared scratch folder, for results that
    several steps read or that must not be computed twice."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a materialised table that survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet table; an empty one if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
