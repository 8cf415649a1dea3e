"""Connected components of a large sparse graph by alternating large-star and small-star steps, all as joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzgrid.storage import cut


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs, in any direction -> (node, root): each node that has an edge and isn't its component's least, with that least node.

    Self-loops and repeated edges do no harm; null ends are left out. No step collects nodes or edges to the driver: only the counts
    that tell whether it is done. The number of rounds grows with the logarithm of the components' diameters.
    """
    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _done(stars):
        stars = cut(_small_star(_large_star(stars)))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _done(stars: DataFrame) -> bool:
    """Whether each node has one edge, and that to a node without edges of its own."""
    nodes = stars.select("u").unionByName(stars.select(F.col("v").alias("u")).distinct(), False)
    return nodes.groupBy("u").count().where("count > 1").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


class Labels:
    """Least labels of nodes 0..n-1 under edges that come in arrays."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        of = self.of
        while True:
            x, y = of[a], of[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(of, np.maximum(x, y), np.minimum(x, y))
            while (jumped := of[of]).tobytes() != of.tobytes():
                of[:] = jumped
