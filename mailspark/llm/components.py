"""Connected components of a graph of integer ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailspark.session import checkpointed


def forest(left: np.ndarray, right: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Each linked row number with the smallest that its links, within a task, reach."""
    label = np.arange(nodes)
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(nodes))
    return moved, label[moved]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``.

    A component is named after its smallest node. Large and small stars
    alternate (Kiveris et al., 2014): every step joins each node's neighbours to
    the smallest of them, so the number of edges never grows and a node with any
    number of neighbours is one side of a join with a unique key. Every round is
    checkpointed.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = checkpointed(pairs.where("a < b").distinct())
    for _ in range(rounds):
        if _are_stars(pairs):
            break
        pairs = checkpointed(_small_star(_large_star(pairs)))
    else:
        raise RuntimeError("components did not settle")
    nodes = pairs.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _are_stars(pairs: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, or only larger ones."""
    one, none = F.lit(1), F.lit(0)
    ends = pairs.select(F.col("b").alias("node"), one.alias("down"), none.alias("up")).unionByName(
        pairs.select(F.col("a").alias("node"), none.alias("down"), one.alias("up")))
    roles = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return roles.where("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def _large_star(pairs: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the smallest node around it."""
    around = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = around.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
    return moved.where("a < b").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Joins every smaller neighbour of a node, and the node, to the smallest."""
    least = pairs.groupBy("b").agg(F.min("a").alias("m"))
    moved = pairs.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    kept = least.select(F.col("m").alias("a"), "b")
    return moved.unionByName(kept).where("a < b").distinct()
