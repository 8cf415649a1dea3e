"""Bounded expansion and closure over edge tables: loops of joins, each node visited once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzgrid.storage import cut

MAX_DEPTH, MAX_NODES, MAX_BYTES = 3, 200, 1_000_000


def expand(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """seeds(node), edges(src, dst) -> (node, depth): the least depth at which each node is reached, cycles once.

    One join for each level; nulls are neither seeds nor targets.
    """
    seen = seeds.where("node IS NOT NULL").select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, max_depth + 1):
        found = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).where("node IS NOT NULL").distinct()
        frontier = cut(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def within_budget(nodes: DataFrame, max_nodes: int, id_column: str = "node") -> DataFrame:
    """Seeds stay; of the others the first `max_nodes` by depth and id: adds kept, and in each row dropped, the number left out, and reason, null if none was."""
    others = nodes.where("depth > 0")
    first = others.orderBy("depth", id_column).limit(max_nodes).select(id_column, F.lit(True).alias("fits"))  # a top-k, not a sort of all
    total = others.agg(F.greatest(F.count("*") - max_nodes, F.lit(0)).alias("dropped"))
    marked = nodes.join(F.broadcast(first), id_column, "left").withColumn("kept", (F.col("depth") == 0) | F.coalesce("fits", F.lit(False))).drop("fits")
    return marked.join(F.broadcast(total)).withColumn("reason", F.when(F.col("dropped") > 0, "max_related_nodes"))


def take_by_bytes(sizes: list[tuple[str, int]], max_nodes: int, max_bytes: int) -> tuple[list[str], dict[str, int]]:
    """A level's nodes in order, an oversized one skipped and the next one tried: (kept, reasons). A level is bounded by max_nodes and its fan-out."""
    kept: list[str] = []
    used, dropped = 0, {"max_related_nodes": 0, "max_payload_bytes": 0}
    for node, size in sizes:
        if len(kept) >= max_nodes:
            dropped["max_related_nodes"] += 1
        elif used + size > max_bytes:
            dropped["max_payload_bytes"] += 1
        else:
            kept.append(node)
            used += size
    return kept, {k: v for k, v in dropped.items() if v}


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """All nodes reachable from the seeds (node), semi-naively: only new nodes are joined again, until there are none."""
    seen = frontier = cut(seeds.where("node IS NOT NULL").select("node").distinct())
    while not frontier.isEmpty():
        found = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).where("node IS NOT NULL").distinct()
        frontier = cut(found.join(seen, "node", "left_anti"))
        seen = cut(seen.unionByName(frontier))
    return seen
