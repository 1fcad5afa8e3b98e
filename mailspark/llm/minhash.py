"""Near duplicates by an inverted join over MinHash coordinates.

Each distinct shingle set has a signature of ``coordinates`` minima. It is posted
under its coordinate-value pairs, rarest first, and only under so many of them
(the prefix) that two signatures agreeing in ``matches`` coordinates must meet in
at least one. Posting lists are merged in two passes:

1. Every member meets the leader of its lists. Collisions with each leader are
   counted, the best leader above the match threshold is kept, and the pair is
   confirmed on the full sets. This joins most of a group of copies at the cost
   of one pair per document.
2. Lists whose members are all in one component by then are skipped. In the
   others, members of different components meet in tiles of bounded size; those
   that reach the match threshold are confirmed on the full sets.

No list is cut, and no group of copies is expanded into all its pairs.

Cases: a null or empty text has an empty set and links with nothing. Rows with
equal sets are one node, with a number of its own, so rows that share a doc_id each
get the component of their own set, and rows without doc_id are compared like others.
A component is named after its smallest doc_id, or null if none of its rows has one.
Of a component the text of one row is kept, one that has this doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.llm.common import groups_in_order, in_groups, own_names, sized
from mailspark.llm.components import components, forest
from mailspark.llm.textbytes import mix, shingle_set
from mailspark.session import checkpointed, stored

COORDINATES = 32
MATCHES = 16
# Two sets of Jaccard similarity 0.8 agree in at least 16 of 32 coordinates with
# a probability of 0.99998.
BLOCK = 256
_BUCKETS = 1 << 18
_PACKED = [f"s{i}" for i in range(COORDINATES // 2)]

_random = np.random.default_rng(20240229)
_FACTOR = _random.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_MASK = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def _signature(shingles: np.ndarray) -> np.ndarray:
    """``COORDINATES`` 32-bit minima."""
    out = np.empty(COORDINATES, dtype=np.uint64)
    for at in range(COORDINATES):
        out[at] = ((shingles ^ _MASK[at]) * _FACTOR[at]).min() >> np.uint64(32)
    return out


def _digest(shingles: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that depend on the set only."""
    return mix(shingles).sum(), mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, a hash of the text as ``mark``, set size ``n``, digest ``d0 d1`` and
    packed signature per row."""
    names = ["doc_id", "mark", "n", "d0", "d1", *_PACKED]

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            numbers = np.zeros((rows, 3 + len(_PACKED)), dtype=np.uint64)
            for r, text in enumerate(batch.column(2)):
                shingles = shingle_set(text.as_py(), width)
                if len(shingles):
                    minima = _signature(shingles)
                    numbers[r, 0] = len(shingles)
                    numbers[r, 1:3] = _digest(shingles)
                    numbers[r, 3:] = (minima[0::2] << np.uint64(32)) | minima[1::2]
            columns = [batch.column(0), batch.column(1), *[pa.array(c.view(np.int64)) for c in numbers.T.copy()]]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"{name} bigint" for name in names)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary"))
    return texts.mapInArrow(run, schema)


def _minima(columns: list[np.ndarray]) -> np.ndarray:
    """Unpacked signatures, one row each."""
    packed = np.stack(columns, axis=1).view(np.uint64)
    out = np.empty((len(packed), COORDINATES), dtype=np.uint32)
    out[:, 0::2] = packed >> np.uint64(32)
    out[:, 1::2] = packed & np.uint64(0xFFFFFFFF)
    return out


def _tokens(minima: np.ndarray) -> np.ndarray:
    """One 64-bit value per coordinate and value."""
    return mix(minima.astype(np.uint64) + (np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(32)))


def _packed_columns(source: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [source.column(name).to_numpy(zero_copy_only=False) if isinstance(source, pa.RecordBatch)
            else source.column(name).to_numpy() for name in _PACKED]


def _frequencies(nodes: DataFrame) -> np.ndarray:
    """How often coordinate-value pairs occur, summed in a fixed number of hash
    buckets. It only orders the pairs; any order gives the same links."""
    def run(batches):
        counts = np.zeros(_BUCKETS, dtype=np.int64)
        for batch in batches:
            tokens = _tokens(_minima(_packed_columns(batch)))
            counts += np.bincount((tokens % np.uint64(_BUCKETS)).astype(np.int64).ravel(), minlength=_BUCKETS)
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(counts[hit])], ["bucket", "n"])

    found = nodes.select(*_PACKED).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = found.toArrow()  # at most _BUCKETS rows
    out = np.zeros(_BUCKETS, dtype=np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def _prefix(tokens: np.ndarray, frequencies: np.ndarray, matches: int) -> np.ndarray:
    """Places of the rarest ``COORDINATES - matches + 1`` coordinates in each row."""
    often = frequencies[(tokens % np.uint64(_BUCKETS)).astype(np.int64)]
    # By bucket frequency, then by value: the same order in every row.
    return np.lexsort((tokens, often), axis=1)[:, :COORDINATES - matches + 1]


def postings(nodes: DataFrame, frequency: Broadcast, matches: int = MATCHES) -> DataFrame:
    """``(token, node)`` for the coordinates in the prefix of each node."""
    prefix = COORDINATES - matches + 1

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            tokens = _tokens(_minima(_packed_columns(batch)))
            chosen = np.take_along_axis(tokens, _prefix(tokens, frequency.value, matches), axis=1)
            ids = batch.column("node").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(chosen.ravel().view(np.int64)), pa.array(np.repeat(ids, prefix))], ["token", "node"])

    return nodes.select("node", *_PACKED).mapInArrow(run, "token bigint, node bigint")


def _agreement(left: str, right: str) -> Column:
    """In how many coordinates two packed signatures agree."""
    total = F.lit(0)
    for name in _PACKED:
        differ = F.col(f"{left}.{name}").bitwiseXOR(F.col(f"{right}.{name}"))
        total = total + (F.shiftrightunsigned(differ, 32) == 0).cast("int") + (differ.bitwiseAND(0xFFFFFFFF) == 0).cast("int")
    return total


def _leader_pairs(posts: DataFrame, nodes: DataFrame, matches: int) -> DataFrame:
    """Each node with the list leader it collides with most, if their signatures
    reach the match threshold."""
    leaders = posts.groupBy("token").agg(F.min("node").alias("leader"), F.count("*").alias("size"))
    leaders = leaders.where("size > 1").select("token", "leader")
    met = posts.join(leaders, "token").where("node > leader").groupBy("node", "leader").agg(F.count("*").alias("hits"))
    own, other = nodes.select("node", *_PACKED), nodes.select(F.col("node").alias("leader"), *_PACKED)
    scored = met.join(own.alias("x"), "node").join(other.alias("y"), "leader")
    scored = scored.select("node", "leader", "hits", _agreement("x", "y").alias("agree")).where(F.col("agree") >= matches)
    best = F.max(F.struct("agree", "hits", -F.col("leader"))).alias("best")
    return scored.groupBy("node").agg(best).select(F.col("node").alias("a"), (-F.col("best.col3")).alias("b"))


def _sets(docs: DataFrame, prints: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """Full shingle sets, as bytes, of the classes in ``ids (node, least, text_mark)``, from
    the row that stands for each."""
    def run(batches):
        for batch in batches:
            sets = [shingle_set(text.as_py(), width).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.large_binary())], ["node", "shingles"])

    ids = sized(ids)
    same = F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("mark") == F.col("text_mark"))
    texts = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    picked = texts.join(ids, same).select("node", "text")
    if not prints.select("doc_id", "mark").join(ids, same).groupBy("node").count().where("count > 1").isEmpty():
        picked = picked.dropDuplicates(["node"])
    return picked.mapInArrow(run, "node bigint, shingles binary")


def _close(common: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    return (100 * common >= percent * (left + right - common)) & (common > 0)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    def run(batches):
        for batch in batches:
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            keep = np.zeros(batch.num_rows, dtype=bool)
            for r, (x, y) in enumerate(zip(left, right)):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[r] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def _tiles(posts: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Members of lists that hold several components, dealt to tiles.

    The members of a list's largest component need not meet each other, only the
    rest; the rest meet everybody. Both sides are cut into blocks of about
    ``BLOCK`` members, and a tile is a pair of blocks.
    """
    named = posts.join(known, posts.node == known.of, "left")
    named = named.select("token", "node", F.coalesce("component", "node").alias("component"))
    by_component = named.groupBy("token", "component").agg(F.count("*").alias("n"))
    lists = by_component.groupBy("token").agg(
        F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("main"))
    lists = lists.where(F.col("size") > F.col("main.n")).select(
        "token", F.col("main.component").alias("main"),
        F.ceil((F.col("size") - F.col("main.n")) / BLOCK).cast("int").alias("rest_blocks"),
        F.ceil(F.col("main.n") / BLOCK).cast("int").alias("main_blocks"),
    )
    cut = named.join(lists, "token")
    in_main = F.col("component") == F.col("main")
    spread = F.xxhash64("node")
    block = F.when(in_main, F.col("rest_blocks") + F.pmod(spread, F.col("main_blocks")))
    block = block.otherwise(F.pmod(spread, F.col("rest_blocks"))).cast("int")
    cut = cut.withColumn("block", block)
    last = F.when(in_main, F.col("rest_blocks") - 1).otherwise(F.col("rest_blocks") + F.col("main_blocks") - 1)
    cut = cut.select("token", "node", "component", "block", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    cut = cut.select(
        "token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "node", "component", "block",
    )
    sizes = nodes.select("node", "n", *_PACKED)
    return cut.join(sizes, "node")


_TILE = ["token", "i", "j"]


def _sides(tile: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two blocks of a tile."""
    blocks = tile.column("block").to_numpy()
    i, j = tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
    return np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)


def _open_members(tiles: DataFrame, frequency: Broadcast, matches: int, percent: int) -> DataFrame:
    """Members with a partner in another component of their tile that reaches the
    match threshold and is not ruled out by its size. A pair that shares several lists
    is looked at in the one with the smallest token."""
    def run(batches):
        for tile in groups_in_order(batches, _TILE):
            left, right = _sides(tile)
            if len(left) == 0 or len(right) == 0:
                continue
            component, size = tile.column("component").to_numpy(), tile.column("n").to_numpy()
            able = component[left][:, None] != component[right][None, :]
            able &= 100 * size[left][:, None] >= percent * size[right][None, :]
            able &= 100 * size[right][None, :] >= percent * size[left][:, None]
            x, y = np.nonzero(able)
            minima = _minima(_packed_columns(tile))
            tokens = _tokens(minima)
            listed = np.zeros(tokens.shape, dtype=bool)
            np.put_along_axis(listed, _prefix(tokens, frequency.value, matches), True, axis=1)
            here = np.uint64(tile.column("token")[0].as_py() & 0xFFFFFFFFFFFFFFFF)
            hit = np.zeros(tile.num_rows, dtype=bool)
            for at in range(0, len(x), 1 << 15):
                a, b = left[x[at:at + (1 << 15)]], right[y[at:at + (1 << 15)]]
                same = minima[a] == minima[b]
                met = np.flatnonzero(same.sum(axis=1) >= matches)
                a, b = a[met], b[met]
                shared = np.where(same[met] & listed[a] & listed[b], tokens[a], np.uint64(0xFFFFFFFFFFFFFFFF))
                first = shared.min(axis=1) == here
                hit[a[first]] = hit[b[first]] = True
            if hit.any():
                yield from tile.filter(pa.array(hit)).select([*_TILE, "node", "component", "block"]).combine_chunks().to_batches()

    schema = "token bigint, i int, j int, node bigint, component bigint, block int"
    return in_groups(tiles, _TILE).mapInArrow(run, schema)


def _tile_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of different components of a tile, confirmed on the
    full sets. Of the links a forest is left: at most one row per member."""
    def run(batches):
        for tile in groups_in_order(batches, _TILE):
            left, right = _sides(tile)
            if len(left) == 0 or len(right) == 0:
                continue
            sets_ = [np.frombuffer(s, dtype=np.uint64) for s in tile.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets_])
            common = _common(sets_, left, right)
            component, node = tile.column("component").to_numpy(), tile.column("node").to_numpy()
            linked = _close(common, size[left][:, None], size[right][None, :], percent)
            linked &= component[left][:, None] != component[right][None, :]
            x, y = np.nonzero(linked)
            if len(x):
                member, root = forest(left[x], right[y], tile.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(node[member]), pa.array(node[root])], ["a", "b"])

    joined = members.join(sets, "node")
    return in_groups(joined, _TILE).mapInArrow(run, "a bigint, b bigint")


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, strip: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left with every right set.

    Shingles that occur once are left out, the others become columns of 0/1
    matrices, multiplied in strips.
    """
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    rows, column = rows[shared], column[shared]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    _, column = np.unique(column, return_inverse=True)
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    n = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, n, strip):
        lo, hi = np.searchsorted(column, [start, start + strip])
        matrix = np.zeros((len(sets), min(strip, n - start)), dtype=np.float32)
        matrix[rows[lo:hi], column[lo:hi] - start] = 1
        total += matrix[left] @ matrix[right].T
    return np.rint(total).astype(np.int64)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, matches: int = MATCHES) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, mark`` for every row of ``docs``.

    Documents link if their sets of ``width``-word shingles have a Jaccard
    similarity of at least ``percent`` in a hundred; ``component_id`` is the
    smallest doc_id reachable over links, and ``kept`` says that the row's text is the
    one that stays of its component.
    """
    prints = stored(fingerprints(docs, width), "fingerprints")
    digests = ["d0", "d1"]
    classes = prints.where("n > 0").groupBy(*digests).agg(
        F.min("doc_id").alias("least"), F.coalesce(F.min_by("mark", "doc_id"), F.min("mark")).alias("text_mark"),
        F.min("n").alias("n"), *[F.min(s).alias(s) for s in _PACKED])
    # Class numbers come from partition and place and are written down before use.
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    names = nodes.select("node", "least", "text_mark")
    frequency = docs.sparkSession.sparkContext.broadcast(_frequencies(nodes))
    posts = stored(postings(nodes, frequency, matches), "postings")

    stars = checkpointed(_leader_pairs(posts, nodes, matches))
    members = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    star_sets = stored(_sets(docs, prints, checkpointed(names.join(members, "node")), width), "sets")
    links = stored(_confirmed(stars, star_sets, percent), "links")
    known = checkpointed(components(links)).select(F.col("node").alias("of"), "component")

    open_members = stored(_open_members(_tiles(posts, nodes, known), frequency, matches, percent), "open")
    rest = checkpointed(names.join(open_members.select("node").distinct(), "node"))
    tile_sets = _sets(docs, prints, rest, width)
    more = stored(_tile_links(open_members, tile_sets, percent), "links")
    found = checkpointed(components(links.unionByName(more))).select(F.col("node").alias("of"), "component")

    of_class = nodes.select(*digests, "node", "least", "text_mark").join(found, F.col("node") == F.col("of"), "left")
    of_class = stored(of_class.select(*digests, "node", "least", "text_mark", F.coalesce("component", "node").alias("component")), "components")
    # The class that stays: of those with the smallest doc_id, or of all without any, the first.
    stays = of_class.groupBy("component").agg(F.min(F.struct(F.col("least").isNull(), "least", "text_mark", "node")).alias("first"))
    of_class = of_class.join(stays, "component").select(
        *digests, F.col("first.least").alias("component"),
        F.when(F.col("first.node") == F.col("node"), F.col("text_mark")).alias("stays"))
    joined = prints.select("doc_id", "mark", "n", *digests).join(of_class, digests, "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    own = F.col("doc_id").eqNullSafe(F.col("component")) & F.col("mark").eqNullSafe(F.col("stays"))
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.when(F.col("n") > 0, own).otherwise(True).alias("kept"), "mark",
    )


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates; rows that repeat both
    doc_id and text are one."""
    found = stored(near_duplicates(docs, width, percent), "groups")
    doc, text, mark = own_names("doc", "text", "mark")
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias(doc), F.col("mark").alias(text)).distinct()
    marked = docs.withColumn(mark, F.xxhash64("text"))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc)) & (F.col(mark) == F.col(text))
    left = marked.join(sized(dropped), same, "left_anti")
    if not found.where("kept").groupBy("doc_id", "mark").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", mark])
    return left.drop(mark)
