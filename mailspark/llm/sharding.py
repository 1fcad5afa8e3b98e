"""Shards of nearly equal bytes by k-d partitioning.

The documents are points in a space of metadata. A node that is to become several
shards is split along its widest dimension at the weighted median, the weights
being bytes; with an odd number of shards the split point is the matching
fraction. Rows are ordered by (value, doc_id, size, checksum, row number), so that rows
with one value, a source that a third of the documents share for instance, are split
as well, and so are rows without doc_id or with one doc_id for all. Source and
language count by a 52-bit hash of the whole value: equal values lie together, and
values that share a prefix differ.

A median is found without sorting the table: the node's bytes are summed in
``BINS`` bins between its bounds, the bin that holds the median becomes the new
bounds, and so on down to a single key; all nodes of a level take part in the same
pass. Only a few numbers per node leave the executors. Everything runs on a narrow
table of keys and sizes.

Cases: a null text has size 1 and the checksum 0, as the empty text. Null metadata
come before all other values. Rows that are equal in everything but their place in the
table are dealt by the hash of that place; which of them comes where may change if the
table is read in other partitions. An empty table gives no rows. ``with_shard`` replaces
columns named size and shard.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailspark.operators.skew import sums_by_range
from mailspark.session import checkpointed, stored

BINS = 4096
LAW = "bytes"
# What orders rows of one value; the last differs between any two rows.
TIES = ("place", "length", "check", "row")
# Below every id and value.
_LOWEST = -(1 << 63)


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def _category(text: Column) -> Column:
    """A whole value as a number that doubles hold exactly; -1 for null."""
    return F.when(text.isNull(), F.lit(-1).cast("bigint")).otherwise(_low_bits(F.xxhash64(text)))


def _low_bits(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit((1 << 52) - 1))


def metadata(docs: DataFrame) -> dict[str, Column]:
    """The dimensions, and what else tells rows apart: whole numbers."""
    return {
        "place": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LOWEST)),
        "source": _category(F.col("source")),
        "lang": _category(F.col("lang")),
        "length": text_size(F.col("text")),
        "check": F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")),
        "row": _low_bits(F.xxhash64(F.monotonically_increasing_id())),
    }


class _Node:
    """A part of the tree that becomes the shards ``first .. first + shards - 1``."""

    def __init__(self, first: int, shards: int):
        self.first, self.shards = first, shards


def _widths(points: DataFrame, names: list[str]) -> dict[str, float | None]:
    """How wide the whole table is in each dimension."""
    spans = [F.expr(f"cast(max({n}) as double) - cast(min({n}) as double)").alias(n) for n in names]
    return points.agg(*spans).first().asDict()


def _widest(points: DataFrame, names: list[str], whole: dict[str, float | None]) -> DataFrame:
    """Per node its bytes, its widest dimension and the bounds in it.

    Widths are compared as fractions of the whole table's; equal ones go by order.
    """
    bounds = points.groupBy("node").agg(
        F.sum("size").alias("bytes"),
        *[f(n).alias(f"{p}_{n}") for n in names for f, p in ((F.min, "lo"), (F.max, "hi"))])
    fraction = {
        n: (F.col(f"hi_{n}").cast("double") - F.col(f"lo_{n}").cast("double")) / F.lit(float(whole[n])) if whole[n] else F.lit(0.0)
        for n in names}
    best = F.array(*[fraction[n] for n in names])
    dim = (F.array_position(best, F.array_max(best)) - 1).cast("int")
    pick = lambda p: F.get(F.array(*[F.col(f"{p}_{n}") for n in names]), dim)
    return bounds.select("node", "bytes", dim.alias("dim"), pick("lo").alias("lo"), pick("hi").alias("hi"))


def _bin(value: Column, lo: Column, hi: Column) -> Column:
    """Equal parts of lo..hi; non-decreasing in the value, and more than one if hi > lo."""
    width = hi.cast("double") - lo.cast("double")
    part = F.floor((value.cast("double") - lo.cast("double")) / width * BINS)
    # Where doubles are too coarse, at least the largest value stands apart.
    return F.when(hi == lo, F.lit(0)).when(value == hi, F.lit(BINS)).otherwise(F.least(part, F.lit(BINS - 1))).cast("int")


def _by_node(values: dict[int, int], shards: int) -> Column:
    """The value of each row's node, from a literal array over node numbers."""
    return F.get(F.array(*[F.lit(values.get(n)).cast("bigint") for n in range(shards)]), F.col("node"))


Search = dict[int, dict[str, int]]


def _refine(points: DataFrame, search: Search, key: Column, shards: int) -> Search:
    """One pass: the bin of each node in which the wanted weight is reached.

    ``search`` has lo, hi, before and want per node; ``before`` lies below ``lo``.
    """
    open_ = {n: s for n, s in search.items() if s["lo"] < s["hi"]}
    lo, hi = (_by_node({n: s[end] for n, s in open_.items()}, shards) for end in ("lo", "hi"))
    inside = points.select("node", "size", key.alias("key"), lo.alias("lo"), hi.alias("hi")).where("key >= lo AND key <= hi")
    binned = inside.groupBy("node", _bin(F.col("key"), F.col("lo"), F.col("hi")).alias("bin")).agg(
        F.sum("size").alias("weight"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    # At most BINS + 1 rows per node; summed up in bin order.
    before = F.sum("weight").over(Window.partitionBy("node").orderBy("bin")) - F.col("weight") + _by_node({n: s["before"] for n, s in open_.items()}, shards)
    reached = binned.withColumn("before", before).where(F.col("before") + F.col("weight") >= _by_node({n: s["want"] for n, s in open_.items()}, shards))
    found = reached.groupBy("node").agg(F.min_by(F.struct("lo", "hi", "before"), "bin").alias("r")).select("node", "r.*")
    narrowed = {r["node"]: {"lo": r["lo"], "hi": r["hi"], "before": r["before"], "want": search[r["node"]]["want"]} for r in found.collect()}
    return {**search, **narrowed}


def _search(points: DataFrame, search: Search, key: Column, shards: int) -> Search:
    """Narrows ``lo..hi`` of all nodes to the one key at which ``want`` is reached."""
    for _ in range(64):
        if all(s["lo"] == s["hi"] for s in search.values()):
            return search
        search = _refine(points, search, key, shards)
    raise RuntimeError("the median search did not settle")


def _split(
    points: DataFrame, nodes: dict[int, _Node], names: list[str], whole: dict[str, float | None], shards: int,
) -> list[tuple]:
    """``node, dim, value, *ties``: the last key of the left part of each node."""
    search, dims = {}, {}
    for r in _widest(points, names, whole).collect():  # a row per node of the level
        parts = nodes[r["node"]].shards
        # The left part ends with the row that reaches its share, or just before.
        want = max(1, (2 * r["bytes"] * (parts // 2) + parts) // (2 * parts))
        search[r["node"]] = {"lo": r["lo"], "hi": r["hi"], "before": 0, "want": want}
        dims[r["node"]] = r["dim"]
    if not search:
        return []
    rows = points.withColumn("value", F.get(F.array(*[F.col(n) for n in names]), _by_node(dims, shards).cast("int")))
    order = ("value", *TIES)
    keys: dict[int, list[int]] = {n: [] for n in search}
    for number, key in enumerate(order):
        search = _search(rows, search, F.col(key), shards)
        for n, s in search.items():
            keys[n].append(s["lo"])
        rows = rows.where(F.col(key) == _by_node({n: s["lo"] for n, s in search.items()}, shards))
        # What is left per node: rows with one value in all keys so far.
        rest = order[number + 1:]
        left = rows.groupBy("node").agg(
            F.sum("size").alias("weight"),
            *[f(k).alias(f"{p}_{k}") for k in rest for f, p in ((F.min, "lo"), (F.max, "hi"))]).collect()
        if all(r[f"lo_{k}"] == r[f"hi_{k}"] for r in left for k in rest):
            for r in left:
                keys[r["node"]] += [r[f"lo_{k}"] for k in rest]
            break
        search = {r["node"]: {**search[r["node"]], "lo": r[f"lo_{rest[0]}"], "hi": r[f"hi_{rest[0]}"]} for r in left}
    cuts = []
    for r in left:
        n, at = r["node"], search[r["node"]]
        # The row that reaches the share goes to the side where it errs less.
        over = at["before"] + r["weight"] - at["want"]
        stays = over <= at["want"] - at["before"]
        cuts.append((n, dims[n], *keys[n][:-1], keys[n][-1] - (not stays)))
    return cuts


def _advance(node: Column, cuts: list[tuple], at: dict[str, Column], names: list[str]) -> Column:
    """The node a row is in after ``cuts``, which are literals of the expression."""
    moved = node
    for number, dim, *last, right in cuts:
        key = F.struct(at[names[dim]].alias("value"), *[at[t].alias(t) for t in TIES])
        cut = F.struct(*[F.lit(v).cast("bigint").alias(k) for k, v in zip(("value", *TIES), last)])
        moved = F.when((node == number) & (key > cut), F.lit(right)).otherwise(moved)
    return moved


def k_d_tree(points: DataFrame, names: list[str], shards: int) -> list[list[tuple]]:
    """The cuts of every level, ``(node, dim, value, *ties, right)`` each: rows of
    ``node`` above the key (value, *ties) go to node ``right``."""
    nodes, levels = {0: _Node(0, shards)}, []
    points = points.withColumn("node", F.lit(0))
    at, whole = {n: F.col(n) for n in points.columns}, _widths(points, names)
    while any(n.shards > 1 for n in nodes.values()):
        # Nodes are named after their first shard, so closed ones keep their name.
        open_ = [k for k, n in nodes.items() if n.shards > 1]
        active = points.where(F.col("node").isin(open_)) if len(open_) < len(nodes) else points
        cuts = [(*c, nodes[c[0]].first + nodes[c[0]].shards // 2) for c in _split(active, nodes, names, whole, shards)]
        if not cuts:
            break
        levels.append(cuts)
        points = checkpointed(points.withColumn("node", _advance(F.col("node"), cuts, at, names)))
        after = {}
        for k, n in nodes.items():
            half = n.shards // 2
            if half:
                after[n.first + half] = _Node(n.first + half, n.shards - half)
            after[k] = _Node(n.first, half or n.shards)
        nodes = after
    return levels


def _shard(at: dict[str, Column], levels: list[list[tuple]], names: list[str]) -> Column:
    node = F.lit(0)
    for cuts in levels:
        node = _advance(node, cuts, at, names)
    return node.cast("int")


# Dimensions in the order in which equal widths are resolved.
DIMENSIONS = ["source", "lang", "length", "place"]


def _points(docs: DataFrame) -> DataFrame:
    """Narrow rows: id, dimensions, ties and size."""
    at = metadata(docs)
    points = docs.select(F.col("doc_id").cast("bigint"), *[c.alias(n) for n, c in at.items()])
    return stored(points.withColumn("size", F.col("length")), "points")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``slot`` counts the rows of a shard from 0, in order of doc_id.
    """
    points = _points(docs)
    levels = k_d_tree(points, DIMENSIONS, shards)
    placed = points.withColumn("shard", _shard({n: F.col(n) for n in points.columns}, levels, DIMENSIONS))
    counted = sums_by_range(placed, "shard", ["place", "size", "check"], {"slot": F.lit(1).cast("bigint")})
    return counted.select(
        "doc_id", "size", F.col("check").alias("text_crc32"), F.lit(LAW).alias("law"), "shard", (F.col("slot") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def with_shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``docs`` with ``size`` and ``shard``, in place of such columns it has. The tree is found on narrow rows and
    then an expression, so texts are not moved."""
    levels = k_d_tree(_points(docs), DIMENSIONS, shards)
    # Evaluated once per row, in a column of its own, before the tree compares it.
    key = f"_key_{uuid.uuid4().hex}"
    keyed = docs.withColumn(key, F.struct(*[c.alias(n) for n, c in metadata(docs).items()]))
    shard = _shard({n: F.col(key)[n] for n in metadata(docs)}, levels, DIMENSIONS)
    return keyed.withColumns({"size": F.col(key)["length"], "shard": shard}).drop(key)


def shards_for(docs: DataFrame, target_bytes: int) -> int:
    """How many shards bring the leaves down to ``target_bytes``."""
    total = docs.agg(F.sum(text_size(F.col("text")))).first()[0] or 0
    return max(1, math.ceil(total / target_bytes))
