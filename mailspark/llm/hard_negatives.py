"""Hard negatives by coordinate pruning in length buckets, after LEMP.

Vectors are scaled to whole numbers. All rows are sorted by length (norm) into buckets of
at most ``BUCKET``, each one binary row that holds the vectors and, for every coordinate,
the list of its rows in the order of that coordinate's normalised value. Anchors are
packed into blocks, and every block meets every bucket, in groups of ``GROUP`` buckets
that one task takes from the longest vectors to the shortest.

For an anchor q and a score threshold t, rows of a bucket whose longest vector is l can
only reach t with a cosine of c = t / (|q| l). A bucket with c > 1 is left out. Otherwise
the ``FOCUS`` largest coordinates of q each bound the normalised values that a row at
least that close can have,

    q_f c - sqrt((1 - q_f^2)(1 - c^2)) <= p_f <= q_f c + sqrt((1 - q_f^2)(1 - c^2))

(no bound where the cap around q reaches a pole). Binary search gives the stretch of each
list, the stretches are intersected, and what is left is scored exactly. Thresholds start
from what is asked and rise with the rows found so far in the task.

There are two searches over the same buckets: the positives of each anchor (its best rows
of the same label), then, for every positive, the best rows of another label whose score
lies in a band below the positive's. Tasks return a bounded list per anchor (or positive),
and these meet by anchor. The work is a stated query set against all rows; no bound on
partners is involved, and thresholds that rule out nothing cost a product of whole blocks.

Cases: rows with a null label, a null vector or a null or non-finite component take no
part. Vectors of different lengths do not meet. Rows equal in vec_id, label and vector
are one. Rows without vec_id are no anchors and come last among ties; rows that share a
vec_id are rows of their own. Zero vectors score 0. Scores that exceed 2^53 are computed
with unlimited integers, and given as the nearest long. Empty tables give no rows, and
columns other than vec_id, label and embedding are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailspark.llm.common import groups_in_order, in_groups, sized
from mailspark.session import checkpointed, stored

BUCKET = 2048
ANCHORS = 1024
GROUP = 16
FOCUS = 3
_SLACK = 1e-9
_LAST = np.iinfo(np.int64).max


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``node, vec, label, q, norm``: the rows that take part, once each, with whole
    numbers. ``vec`` orders ties; rows without vec_id have a negative ``node``."""
    rows = vectors.select(
        F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = rows.where(F.col("label").isNotNull() & F.col("e").isNotNull() & finite)
    rows = rows.select("vec_id", "label", F.transform("e", lambda x: F.floor(scale * x)).alias("q")).distinct()
    number = F.monotonically_increasing_id()
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    # The numbers are written down before use.
    return stored(rows.select(
        F.when(F.col("vec_id").isNull(), -1 - number).otherwise(number).alias("node"),
        F.coalesce("vec_id", F.lit(_LAST)).alias("vec"), "label", "q", norm.alias("norm")), "vectors")


def _narrow(whole: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as hold them."""
    for kind in (np.int16, np.int32):
        if whole.size == 0 or (whole.min() >= np.iinfo(kind).min and whole.max() <= np.iinfo(kind).max):
            return whole.astype(kind)
    return whole


_BLOCK = ["width", "size", "kind", "nodes", "vecs", "labels", "norms", "q", "orders", "longest", "more"]
_BLOCK_DDL = (
    "width int, size int, kind string, nodes binary, vecs binary, labels binary, norms binary, q binary, orders binary, "
    "longest double, more binary")


class _Block:
    """Vectors of one width with their keys."""

    def __init__(self, row: dict):
        n, width = row["size"], row["width"]
        self.nodes, self.vecs, self.labels = (np.frombuffer(row[k], np.int64) for k in ("nodes", "vecs", "labels"))
        self.norms = np.frombuffer(row["norms"], np.float64)
        self.q = np.frombuffer(row["q"], row["kind"]).reshape(n, width)
        self.orders = np.frombuffer(row["orders"], np.uint16).reshape(width, n) if row["orders"] else None
        self.longest, self.width = row["longest"], width
        self.more = np.frombuffer(row["more"], np.int64).reshape(n, -1) if row["more"] else None
        self.largest = float(np.abs(self.q.astype(np.float64)).max()) if self.q.size else 0.0
        self.exact = self.q.astype(np.float64)
        self.unit = self.exact / np.where(self.norms > 0, self.norms, 1.0)[:, None]

    def scores(self, rows: np.ndarray | None, q: np.ndarray, largest: float) -> np.ndarray:
        """Products of rows (all if None) with a vector, exact."""
        if self.largest * largest * max(self.width, 1) < 1 << 53:
            # Sums of whole numbers that doubles hold exactly.
            return ((self.exact if rows is None else self.exact[rows]) @ q.astype(np.float64)).astype(np.int64)
        chosen = self.q if rows is None else self.q[rows]
        ends = np.iinfo(np.int64)
        sums = chosen.astype(object) @ q.astype(object)
        return np.array([min(max(int(x), ends.min), ends.max) for x in sums], dtype=np.int64)


def _packed(rows: DataFrame, size: int, lists: bool) -> DataFrame:
    """Rows ``node, vec, label, q, norm, more``, as they lie in the tasks, in blocks."""
    def block(part: list[tuple], width: int) -> pa.RecordBatch:
        nodes, vecs, labels, vectors, norms, more = (list(x) for x in zip(*part))
        q = np.array(vectors, dtype=np.int64).reshape(len(part), width)
        norm = np.array(norms, dtype=np.float64)
        orders = b""
        if lists:
            unit = q / np.where(norm > 0, norm, 1.0)[:, None]
            orders = np.argsort(unit, axis=0, kind="stable").T.astype(np.uint16).tobytes()
        small = _narrow(q)
        row = {"width": width, "size": len(part), "kind": small.dtype.name, "nodes": np.array(nodes).tobytes(),
               "vecs": np.array(vecs).tobytes(), "labels": np.array(labels).tobytes(), "norms": norm.tobytes(), "q": small.tobytes(),
               "orders": orders, "longest": float(norm.max()), "more": np.array(more, dtype=np.int64).tobytes()}
        return pa.RecordBatch.from_arrays([pa.array([row[k]], pa.int32() if k in ("width", "size") else None) for k in _BLOCK], _BLOCK)

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            columns = [column.to_pylist() for column in batch.columns]
            for row in zip(*columns):
                if held and (len(held) == size or len(held[0][3]) != len(row[3])):
                    yield block(held, len(held[0][3]))
                    held = []
                held.append(row)
        if held:
            yield block(held, len(held[0][3]))

    ordered = rows.select("node", "vec", "label", "q", "norm", "more")
    return ordered.mapInArrow(run, _BLOCK_DDL)


def _numbered(blocks: DataFrame, name: str, *order: Column) -> DataFrame:
    """Blocks with dense numbers, from one narrow row per block."""
    blocks = stored(blocks.withColumn("mark", F.monotonically_increasing_id()), name)
    dense = F.row_number().over(Window.orderBy(*order, "mark")).cast("bigint") - 1
    numbers = checkpointed(blocks.select("mark", dense.alias(name)))
    return stored(blocks.join(sized(numbers), "mark").drop("mark"), name)


def length_buckets(vectors: DataFrame) -> DataFrame:
    """All vectors in buckets of falling length with sorted coordinate lists."""
    none = F.array().cast("array<bigint>").alias("more")
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.size("q"), F.desc("norm"), F.xxhash64("vec", "node")]
    dealt = vectors.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return _numbered(_packed(dealt.select("*", none), BUCKET, True), "bucket", F.desc("longest"))


def anchor_blocks(anchors: DataFrame) -> DataFrame:
    """Anchors, with their ``more`` numbers, in blocks."""
    dealt = anchors.repartition(max(1, math.ceil(anchors.count() / ANCHORS)), F.size("q"), "node")
    return _numbered(_packed(dealt.sortWithinPartitions(F.size("q")), ANCHORS, False), "i", F.col("width"))


def _meetings(anchors: DataFrame, buckets: DataFrame) -> DataFrame:
    """Every block of anchors with the buckets of its width, by number."""
    heads = anchors.select("i", F.col("width").alias("w"))
    pairs = buckets.select("bucket", "width").join(sized(checkpointed(heads)), F.col("width") == F.col("w")).select("i", "bucket")
    one = anchors.select("i", *[F.col(c).alias(f"a_{c}") for c in _BLOCK])
    met = pairs.join(buckets, "bucket").join(sized(one, 64), "i")
    return met.withColumn("part", F.floor(F.col("bucket") / GROUP))


def _candidates(bucket: _Block, unit: np.ndarray, focus: np.ndarray, norm: float, threshold: float) -> np.ndarray | None:
    """Rows of a bucket that can reach a score; None for all of them."""
    if threshold <= 0 or norm == 0:
        return None
    if bucket.longest == 0:
        return np.empty(0, dtype=np.int64)
    c = threshold / (norm * bucket.longest) - _SLACK
    if c > 1:
        return np.empty(0, dtype=np.int64)
    if c <= 0:
        return None
    found = None
    for f in focus:
        spread = math.sqrt(max(0.0, (1 - unit[f] ** 2) * (1 - c * c)))
        low = -1.0 if -unit[f] >= c else unit[f] * c - spread
        high = 1.0 if unit[f] >= c else unit[f] * c + spread
        order = bucket.orders[f]
        values = bucket.unit[order, f]
        start, end = np.searchsorted(values, [low - _SLACK, high + _SLACK])
        if end - start == len(order):
            continue
        inside = np.zeros(len(order), dtype=bool)
        inside[order[start:end]] = True
        found = inside if found is None else found & inside
    return None if found is None else np.flatnonzero(found)


def _best(scores: np.ndarray, vecs: np.ndarray, nodes: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k``: higher scores, then smaller vec, then node."""
    if len(scores) > 4 * k:
        # All that can be among them, ties included.
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((nodes[some], vecs[some], -scores[some]))[:k]]


class _Top:
    """The best rows of one question so far, and the score a further row has to reach."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.found = [np.empty(0, dtype=np.int64)] * 3

    def threshold(self) -> float:
        floor = -math.inf if self.low is None else self.low
        return max(floor, int(self.found[0][-1])) if len(self.found[0]) == self.k else floor

    def take(self, scores: np.ndarray, vecs: np.ndarray, nodes: np.ndarray) -> None:
        inside = scores >= self.threshold()
        if self.high is not None:
            inside &= scores <= self.high
        if inside.any():
            joined = [np.concatenate(x) for x in zip(self.found, (scores[inside], vecs[inside], nodes[inside]))]
            best = _best(*joined, self.k)
            self.found = [x[best] for x in joined]


_FOUND = ["anchor", "question", "node", "vec", "score"]


def _search(meetings: DataFrame, k: int, questions, same: bool) -> DataFrame:
    """Per task and question the best ``k`` rows whose label is the anchor's, or is not.

    ``questions`` makes the ``_Top`` lists of an anchor from its ``more`` numbers.
    """
    def run(batches):
        for group in groups_in_order(batches, ["i", "part"]):
            rows = sorted(group.to_pylist(), key=lambda r: r["bucket"])
            anchors = _Block({k_: rows[0][f"a_{k_}"] for k_ in _BLOCK})
            tops = [questions(anchors.more[a] if anchors.more is not None else ()) for a in range(len(anchors.nodes))]
            focus = np.argsort(-np.abs(anchors.unit), axis=1, kind="stable")[:, :FOCUS]
            for row in rows:
                bucket = _Block(row)
                for a, top in enumerate(tops):
                    if not top:
                        continue
                    least = min(t.threshold() for t in top)
                    chosen = _candidates(bucket, anchors.unit[a], focus[a], anchors.norms[a], least)
                    some = np.arange(len(bucket.nodes)) if chosen is None else chosen
                    match = bucket.labels[some] == anchors.labels[a]
                    some = some[(match if same else ~match) & (bucket.nodes[some] != anchors.nodes[a])]
                    if len(some) == 0:
                        continue
                    scores = bucket.scores(some, anchors.q[a], anchors.largest)
                    for t in top:
                        t.take(scores, bucket.vecs[some], bucket.nodes[some])
            yield from _answers(anchors, tops)

    schema = "anchor bigint, question int, node bigint, vec bigint, score bigint"
    met = meetings.withColumn("part", F.col("part").cast("bigint"))
    return in_groups(met, ["i", "part"]).mapInArrow(run, schema)


def _answers(anchors: _Block, tops: list[list[_Top]]) -> Iterator[pa.RecordBatch]:
    out: list[list[np.ndarray]] = [[] for _ in _FOUND]
    for node, top in zip(anchors.nodes, tops):
        for question, t in enumerate(top):
            score, vec, found = t.found
            for column, values in zip(out, (np.full(len(found), node), np.full(len(found), question, dtype=np.int32), found, vec, score)):
                column.append(values)
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], _FOUND)


def _merged(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best ``k`` over all tasks, with their ``rank``."""
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec", "node")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _band(score: int, low: int, high: int) -> tuple[int, int]:
    """The scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``vec_id``. ``positives`` rows of the anchor's label
    are taken, and for each the first ``negatives`` rows of other labels with a score of
    ``low`` to ``high`` percent of the positive's.
    """
    rows = whole_vectors(vectors, scale)
    asked = rows.where("node >= 0").withColumn("vec_id", F.col("vec")).where(is_anchor).drop("vec_id")
    buckets = length_buckets(rows)
    plain = asked.withColumn("more", F.array().cast("array<bigint>"))
    near = _search(_meetings(anchor_blocks(plain), buckets), positives, lambda _: [_Top(positives)], same=True)
    near = stored(_merged(near.drop("question"), ["anchor"], positives), "positives")

    # A positive is a question of its anchor; places that an anchor does not fill are -1.
    scores = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("scored"))
    more = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("scored.score", i), F.lit(0)))
    filled = asked.join(scores.withColumnRenamed("anchor", "node"), "node")
    filled = filled.withColumn("more", F.concat(more, F.array(F.size("scored").cast("bigint"))))

    def bands(more_: np.ndarray) -> list[_Top]:
        return [_Top(negatives, *_band(int(score), low, high)) for score in more_[:int(more_[-1])]]

    hard = _search(_meetings(anchor_blocks(filled), buckets), negatives, bands, same=False)
    hard = _merged(hard, ["anchor", "question"], negatives)
    of = near.select(
        F.col("anchor").alias("of"), (F.col("rank") - 1).alias("of_question"), F.col("node").alias("positive"),
        F.col("vec").alias("positive_vec"), F.col("score").alias("positive_score"))
    joined = hard.join(of, (F.col("anchor") == F.col("of")) & (F.col("question") == F.col("of_question")))
    names = asked.select(F.col("node").alias("anchor_node"), F.col("vec").alias("anchor_id"))
    joined = joined.join(names, F.col("anchor") == F.col("anchor_node"))
    return joined.select(
        "anchor_id", F.when(F.col("positive") >= 0, F.col("positive_vec")).alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.when(F.col("node") >= 0, F.col("vec")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
