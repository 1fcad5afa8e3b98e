"""An inverted file over vectors: a collection kept by cell, of which a search reads few.

Cells are the regions around centres that spherical k-means learns on a bounded sample
(``SAMPLE_ROWS`` rows and ``SAMPLE_VALUES`` numbers at most); every row is then put
into the cell of its nearest centre. Rows lie in blocks, partitioned by cell, so the
cells a search leaves out are never opened. A search takes any number of questions: each
marks the cells it probes, blocks of questions and of rows meet where a mark says so, and a
task gives out only rows that reach the k-th score of a question so far.

How many cells are probed is measured when the index is built: as few as give the wanted
recall on questions from the sample. ``exact=True`` goes on from there: cells whose rows
could still beat a question's k-th score, by the angle between question and centre and
the largest angle inside the cell, are probed as well, so the answer is that of the full
scan (``operators.search.top_k`` remains the plain form of it).

Rows without a vector, with another length than the first one's, or with a component
that is null or not finite, and zero vectors have no direction and are not indexed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from mailspark.operators.skew import small_side
from mailspark.session import small_batches, stored

SAMPLE_ROWS = 65_536
SAMPLE_VALUES = 16_000_000
MAX_CELLS = 4096
ROUNDS = 12
# Rows and questions that meet at once.
BLOCK = 1024
QUESTIONS = 256
# Questions whose cells are chosen at once.
SENT = 64
# Blocks of questions that are broadcast, if there are no more of them.
_SMALL_BLOCKS = 256
# Tasks per core in which cells are searched, at most.
_TASKS = 4
# Above any rounding error of angles between unit vectors.
_SLACK = 1e-6


def _direction(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def learn_centres(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means on unit rows; a cell that runs empty starts anew at the row
    that its centre fits worst."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(ROUNDS):
        likeness = sample @ centres.T
        nearest = likeness.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        empty = np.flatnonzero(np.bincount(nearest, minlength=cells) == 0)
        worst = np.argsort(likeness.max(axis=1))[:len(empty)]
        sums[empty] = sample[worst]
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def measured_probes(sample: np.ndarray, centres: np.ndarray, recall: float, k: int, seed: int = 11) -> int:
    """The smallest number of probed cells that finds ``recall`` of the best ``k`` rows
    of the sample, for up to 256 questions from it."""
    rng = np.random.default_rng(seed)
    asked = rng.choice(len(sample), min(256, len(sample)), replace=False)
    home = (sample @ centres.T).argmax(axis=1)
    likeness = sample[asked] @ sample.T
    likeness[np.arange(len(asked)), asked] = -2
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centres)
    best = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
    order = np.argsort(-(sample[asked] @ centres.T), axis=1)
    place = np.argsort(order, axis=1)
    needed = np.sort(place[np.arange(len(asked))[:, None], home[best]].ravel()) + 1
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])


class VectorIndex:
    """An inverted file below a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    # Building

    def build(
        self, rows: DataFrame, key: tuple[str, ...], vector: str = "embedding", cells: int | None = None,
        recall: float = 0.95, k: int = 10,
    ) -> None:
        """Learns the cells, measures how many to probe, and adds ``rows``."""
        usable = rows.where(_direction(F.col(vector))).select(F.col(vector).alias("v"))
        first = usable.first()
        if first is None:
            raise ValueError("no vector to learn cells from")
        width = len(first["v"])
        usable = usable.where(F.size("v") == width)
        total = usable.count()
        wanted = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // width))
        # A hash of the vector picks the sample, so building again gives the same cells.
        chosen = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(min(1.0, wanted / total) * (1 << 30))
        sample = usable.where(chosen).limit(2 * wanted).toArrow().column("v").combine_chunks()
        if len(sample) == 0:
            sample = usable.limit(1).toArrow().column("v").combine_chunks()
        unit = _unit(_matrix(sample, width))
        number = cells or min(MAX_CELLS, max(1, round(math.sqrt(total))))
        centres = learn_centres(unit, min(number, len(unit)))
        probes = measured_probes(unit, centres, recall, k)
        kind = rows.schema[vector].dataType.elementType
        schema = "cell int, centre binary, width int, probes int, precise boolean, vector string, keys array<string>"
        precise = not isinstance(kind, T.FloatType)
        table = [(cell, bytearray(c.tobytes()), width, probes, precise, vector, list(key)) for cell, c in enumerate(centres)]
        self.spark.createDataFrame(table, schema).coalesce(1).write.parquet(f"{self.path}/centres")
        self.add(rows, 0)

    def _learned(self) -> tuple[np.ndarray, dict]:
        rows = sorted(self.spark.read.parquet(f"{self.path}/centres").collect(), key=lambda r: r["cell"])
        return np.stack([np.frombuffer(r["centre"]) for r in rows]), rows[0].asDict()

    def add(self, rows: DataFrame, batch: int) -> None:
        """Puts more rows into the learned cells, as one batch; the cells' numbers are
        written last, and a search reads the batches that have them."""
        centres, facts = self._learned()
        width, kind = facts["width"], T.DoubleType() if facts["precise"] else T.FloatType()
        kept = rows.where(_direction(F.col(facts["vector"])) & (F.size(facts["vector"]) == width)).select(
            F.struct(*facts["keys"]).alias("key"), F.col(facts["vector"]).cast(T.ArrayType(kind, True)).alias("v"))
        shared = self.spark.sparkContext.broadcast(centres)
        float_ = pa.float64() if facts["precise"] else pa.float32()

        def assign(batches):
            for batch_ in batches:
                if batch_.num_rows == 0:
                    continue
                likeness = _unit(_matrix(batch_.column(1), width)) @ shared.value.T
                cell = likeness.argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch_.columns, pa.array(cell), pa.array(likeness[np.arange(len(cell)), cell])], ["key", "v", "cell", "near"])

        def pack(batches):
            for batch_ in batches:
                cell = batch_.column("cell").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
                for begin, end in zip(cuts, cuts[1:]):
                    for at in range(begin, end, BLOCK):
                        part = batch_.slice(at, min(BLOCK, end - at))
                        values = part.column("v").flatten().cast(float_).to_numpy(zero_copy_only=False)
                        keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("key"))
                        least = float(part.column("near").to_numpy().min())
                        yield pa.RecordBatch.from_arrays(
                            [keys, pa.array([values.tobytes()], pa.binary()), pa.array([part.num_rows], pa.int32()), pa.array([least]),
                             pa.array([int(cell[at])], pa.int32())], ["keys", "vectors", "n", "near", "cell"])

        schema = T.StructType([*kept.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType())])
        # Rebalancing cuts a cell that holds much of the table.
        dealt = kept.mapInArrow(assign, schema).hint("rebalance", "cell").sortWithinPartitions("cell", "key")
        packed = T.StructType([
            T.StructField("keys", T.ArrayType(kept.schema["key"].dataType)), T.StructField("vectors", T.BinaryType()),
            T.StructField("n", T.IntegerType()), T.StructField("near", T.DoubleType()), T.StructField("cell", T.IntegerType())])
        folder = f"{self.path}/blocks/batch={batch}"
        dealt.mapInArrow(pack, packed).write.mode("overwrite").partitionBy("cell").parquet(folder)
        written = self.spark.read.schema(packed).parquet(folder)
        numbers = written.groupBy("cell").agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.first(F.lit(batch)).alias("of"))
        numbers.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells/batch={batch}")

    # Searching

    def cells(self) -> DataFrame:
        """``cell, n, near``: rows per cell and the least cosine to its centre."""
        found = self.spark.read.parquet(f"{self.path}/cells")
        return found.groupBy("cell").agg(F.sum("n").alias("n"), F.min("near").alias("near"))

    def blocks(self, cells: list[int] | None = None) -> DataFrame:
        """Blocks of the given cells, from the folders of these alone."""
        batches = [r[0] for r in self.spark.read.parquet(f"{self.path}/cells").select("of").distinct().collect()]
        found = self.spark.read.parquet(f"{self.path}/blocks").where(F.col("batch").isin(batches))
        return found if cells is None else found.where(F.col("cell").isin(cells))

    def probed(self, questions: DataFrame, probes: int | None = None) -> DataFrame:
        """``question, v, cell``: the cells each question is sent to."""
        centres, facts = self._learned()
        return self._sent(questions.select("question", "v"), facts["width"], _nearest(centres, min(probes or facts["probes"], len(centres))))

    def _sent(self, questions: DataFrame, width: int, choose) -> DataFrame:
        """Questions with the cells that ``choose`` names for a batch of them."""
        schema = T.StructType([*questions.select("question", "v").schema.fields, T.StructField("cell", T.IntegerType())])

        small_batches(self.spark)

        def run(batches):
            # A question comes out once per cell, so few are sent at a time.
            for batch in (b.slice(at, SENT) for b in batches for at in range(0, b.num_rows, SENT)):
                more = batch.column(2).to_numpy(zero_copy_only=False) if batch.num_columns > 2 else None
                row, cell = choose(_unit(_matrix(batch.column(1), width)), more)
                chosen = batch.select(["question", "v"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(cell.astype(np.int32))], ["question", "v", "cell"])

        return questions.mapInArrow(run, schema)

    def _asked(self, questions: DataFrame, centres: np.ndarray, width: int, choose) -> DataFrame:
        """Blocks of questions, each question in one of them, with the cells that ``choose``
        names: ``of, asked, units, least, opens, cells``. ``opens`` has a bit per question
        and cell, ``cells`` those that any question of the block opens."""
        fields = questions.select("question", "v").schema.fields
        marked = T.StructType([
            *fields, T.StructField("least", T.DoubleType()), T.StructField("home", T.IntegerType()), T.StructField("opens", T.BinaryType())])
        number, row_bytes = len(centres), (len(centres) + 7) // 8

        small_batches(self.spark)

        def mark(batches):
            for batch in (b.slice(at, SENT) for b in batches for at in range(0, b.num_rows, SENT)):
                least = batch.column(2).to_numpy(zero_copy_only=False)
                unit = _unit(_matrix(batch.column(1), width))
                opens = np.zeros((batch.num_rows, number), dtype=bool)
                opens[choose(unit, least)] = True
                # Questions without an open cell go no further.
                kept = np.flatnonzero(opens.any(axis=1))
                home = (unit @ centres.T).argmax(axis=1).astype(np.int32)
                bits = pa.array([row.tobytes() for row in np.packbits(opens[kept], axis=1)], pa.binary())
                chosen = batch.select(["question", "v", "least"]).take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(home[kept]), bits], ["question", "v", "least", "home", "opens"])

        def pack(batches):
            for batch in (b.slice(at, QUESTIONS) for b in batches for at in range(0, b.num_rows, QUESTIONS)):
                if batch.num_rows == 0:
                    continue
                units = _unit(_matrix(batch.column("v"), width)).tobytes()
                bits = b"".join(batch.column("opens").to_pylist())
                any_ = np.unpackbits(np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, row_bytes), axis=0), count=number)
                names = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("question"))
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array([units], pa.binary()), pa.array([batch.column("least").to_numpy().tobytes()], pa.binary()),
                     pa.array([bits], pa.binary()), pa.array([np.flatnonzero(any_).astype(np.int32)], pa.list_(pa.int32()))],
                    ["asked", "units", "least", "opens", "cells"])

        packed = T.StructType([
            T.StructField("asked", T.ArrayType(fields[0].dataType)), T.StructField("units", T.BinaryType()), T.StructField("least", T.BinaryType()),
            T.StructField("opens", T.BinaryType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])
        # Questions of one cell lie together, so that a block opens few cells if cells are apart.
        dealt = questions.select("question", "v", "least").mapInArrow(mark, marked).hint("rebalance", "home").sortWithinPartitions("home")
        blocks = dealt.mapInArrow(pack, packed).withColumn("of", F.monotonically_increasing_id())
        return stored(blocks, "questions")

    def _answers(self, questions: DataFrame, centres: np.ndarray, width: int, precise: bool, k: int, choose) -> DataFrame:
        """``question, key, score``: the best k rows of ``questions (question, v, least)`` in
        the cells that ``choose`` names, none below ``least``.

        A question is written once, however many cells it opens: its block meets the blocks
        of rows in a nested loop, which shuffles neither. A task keeps the scores of its
        questions' best rows, and gives out what reaches the k-th of them.
        """
        asked = self._asked(questions, centres, width, choose)
        cells = [r[0] for r in asked.select(F.explode("cells").alias("cell")).distinct().limit(MAX_CELLS + 1).collect()]
        # Every task gives out rows for every question: cells share a number of tasks that
        # the cluster sets, not the rows.
        blocks = self.blocks(cells).coalesce(_TASKS * self.spark.sparkContext.defaultParallelism)
        question = questions.schema["question"].dataType
        kind, row_bytes = np.float64 if precise else np.float32, (len(centres) + 7) // 8
        few = small_side(asked, _SMALL_BLOCKS)
        met = blocks.select("cell", "keys", "vectors").join(
            few if few is not asked else asked.hint("shuffle_replicate_nl"), F.array_contains(F.col("cells"), F.col("cell")))
        out = T.StructType([
            T.StructField("question", question), T.StructField("key", blocks.schema["keys"].dataType.elementType),
            T.StructField("score", T.DoubleType())])
        key_type, question_type = to_arrow_type(out["key"].dataType), to_arrow_type(question)

        def best(batches):
            tops: dict[int, np.ndarray] = {}
            for batch in batches:
                for at in range(batch.num_rows):
                    of, cell = batch.column("of")[at].as_py(), batch.column("cell")[at].as_py()
                    opens = np.frombuffer(batch.column("opens")[at].as_py(), np.uint8).reshape(-1, row_bytes)
                    who = np.flatnonzero(opens[:, cell >> 3] & (128 >> (cell & 7)))
                    rows = _unit(np.frombuffer(batch.column("vectors")[at].as_py(), kind).reshape(-1, width))
                    units = np.frombuffer(batch.column("units")[at].as_py()).reshape(-1, width)[who]
                    keys, asked_ = batch.column("keys")[at].values, batch.column("asked")[at].values
                    scores = units @ rows.T
                    if of not in tops:
                        tops[of] = np.repeat(np.frombuffer(batch.column("least")[at].as_py())[:, None], k, axis=1)
                    top = np.concatenate([tops[of][who], scores], axis=1)
                    top = -np.partition(-top, k - 1, axis=1)[:, :k]
                    tops[of][who] = top
                    # All that reach the k-th score: ties are told apart later, by key.
                    place, which = np.nonzero(scores >= top.min(axis=1, keepdims=True))
                    yield pa.RecordBatch.from_arrays(
                        [asked_.take(pa.array(who[place])).cast(question_type), keys.take(pa.array(which)).cast(key_type), pa.array(scores[place, which])],
                        ["question", "key", "score"])

        found = met.select("of", "cell", "keys", "vectors", "asked", "units", "least", "opens").mapInArrow(best, out)
        return _first(found, k)

    def search(
        self, questions: DataFrame, k: int, probes: int | None = None, exact: bool = False, question: str = "question", vector: str = "embedding",
    ) -> DataFrame:
        """``question, rank``, the key columns and ``score``: the best ``k`` rows by cosine
        for every question; ties go to the smaller key."""
        centres, facts = self._learned()
        width, precise = facts["width"], facts["precise"]
        usable = _direction(F.col(vector)) & (F.size(vector) == width)
        asked = stored(questions.where(usable).select(F.col(question).alias("question"), F.col(vector).alias("v")), "asked")
        number = min(probes or facts["probes"], len(centres))
        found = self._answers(asked.withColumn("least", F.lit(-2.0)), centres, width, precise, k, _nearest(centres, number))
        if exact:
            found = stored(found, "found")
            found = _first(found.unionByName(self._answers(
                self._known(asked, found, k), centres, width, precise, k, self._able(centres, number))), k)
        rank = F.row_number().over(_order())
        ranked = found.withColumn("rank", rank).select("question", "rank", "key.*", "score")
        return ranked if question == "question" else ranked.withColumnRenamed("question", question)

    def _known(self, asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
        """Questions with the score that a further row has to reach."""
        counted = found.groupBy("question").agg(F.count("*").alias("got"), F.min("score").alias("least"))
        counted = counted.select(F.col("question").alias("of"), F.when(F.col("got") >= k, F.col("least")).otherwise(-2.0).alias("least"))
        known = asked.join(counted, F.col("question").eqNullSafe(F.col("of")), "left")
        return known.select("question", "v", F.coalesce("least", F.lit(-2.0)).alias("least"))

    def _able(self, centres: np.ndarray, number: int):
        """Names the cells, beside the ``number`` nearest, that can still hold one of the
        best rows of a question."""
        reach = np.full(len(centres), -1.0)
        for row in self.cells().collect():
            reach[row["cell"]] = math.acos(max(-1.0, min(1.0, row["near"]))) + _SLACK

        def able(unit: np.ndarray, least: np.ndarray):
            likeness = unit @ centres.T
            done = np.argsort(-likeness, axis=1, kind="stable")[:, :number]
            nearest = np.maximum(np.arccos(np.clip(likeness, -1, 1)) - reach, 0)
            open_ = (np.cos(nearest) + _SLACK >= least[:, None]) & (reach >= 0)
            np.put_along_axis(open_, done, False, axis=1)
            return np.nonzero(open_)

        return able


def _nearest(centres: np.ndarray, number: int):
    """Names the ``number`` nearest cells of every question of a batch."""
    def nearest(unit: np.ndarray, _):
        order = np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :number]
        return np.repeat(np.arange(len(unit)), number), order.ravel()

    return nearest


def _order() -> Window:
    return Window.partitionBy("question").orderBy(F.desc("score"), "key")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each question; tasks keep no more than these before the shuffle."""
    place = F.row_number().over(_order())
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")
