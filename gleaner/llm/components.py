"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root): every node that has a link, with the smallest node it can reach.

    Each round replaces links by links to the smallest known neighbour, so that components shrink to stars around
    their smallest node in O(log^2) rounds. All work is joins on a node and minima with map-side combination; hubs
    are split by the adaptive skew join. Links with a null end and self-links are ignored; an empty table gives an
    empty result.
    """
    edges = cut(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    before = _state(edges)
    while before[0]:
        edges = cut(_small_star(_large_star(edges)))
        after = _state(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of its neighbours and itself."""
    both = edges.select(F.col("v").alias("node"), F.col("u").alias("other")).unionByName(edges.select(F.col("u").alias("node"), F.col("v").alias("other")))
    least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
    return _joined(edges, "v", least).select("u", F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    inner = _joined(edges, "u", least).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct()


def _joined(edges: DataFrame, end: str, least: DataFrame) -> DataFrame:
    """``edges`` with m of the node at ``end``.

    The key is the node's complement: so neither side comes partitioned by it, both are shuffled for the join alone,
    and the adaptive skew join can split the rows of a hub.
    """
    return edges.withColumn("key", F.bitwise_not(F.col(end))).join(least.select(F.bitwise_not("node").alias("key"), "m"), "key")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def union(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge in ``roots`` (each position's smallest known companion, in place) what the pairs (i, j) link."""
    while len(i):
        x, y = roots[i], roots[j]
        apart = x != y
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(roots, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = roots[roots]
            if np.array_equal(up, roots):
                break
            roots[:] = up
