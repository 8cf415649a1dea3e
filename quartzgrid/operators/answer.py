"""What a search gives back beside its hits: related nodes within budgets, gaps, what was left out and why.

Levels are joins on the structure table. What comes to the driver is a level's ids, sizes and targets: a level begins with at
most as many nodes as the budget lets through the level before, so it is bounded by the budget times a formula's operands.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzgrid.operators.graph import take_by_bytes

#: A node's columns in an answer, besides its depth.
PAYLOAD = ("node_id", "node_type", "sheet_name", "a1_range", "display_value", "formula", "table_name", "column_name", "named_range", "references")


@dataclass
class Expansion:
    depth: dict[str, int] = field(default_factory=dict)
    gaps: list[tuple[str, str]] = field(default_factory=list)
    reasons: list[str] = field(default_factory=list)
    dropped: int = 0
    denied: int = 0
    depth_limit: int | None = None
    bytes_returned: int = 0

    @property
    def truncated(self) -> bool:
        return bool(self.reasons)

    def nodes(self, structure: DataFrame) -> DataFrame:
        """The payload of the nodes that fitted, with their depth. Few rows: they are within the budgets."""
        spark = structure.sparkSession
        kept = spark.createDataFrame(list(self.depth.items()), "node_id string, depth int")
        return structure.join(F.broadcast(kept), "node_id").select(*(c for c in PAYLOAD if c in structure.columns), "depth")

    def summary(self, spark) -> DataFrame:
        row = (self.truncated, "; ".join(dict.fromkeys(self.reasons)) or None, self.dropped, self.denied, self.depth_limit, self.bytes_returned)
        return spark.createDataFrame([row], "truncated boolean, reason string, dropped_nodes int, denied_nodes int, depth_limit int, bytes_returned long")

    def gap_rows(self, spark) -> DataFrame:
        return spark.createDataFrame(self.gaps, "text string, reason string")


def payload_bytes(structure: DataFrame) -> Column:
    """Bytes of a node's payload as JSON."""
    return F.octet_length(F.to_json(F.struct(*(F.col(c) for c in PAYLOAD if c in structure.columns))))


def expand(seeds: list[str], visible: DataFrame, everything: DataFrame, max_depth: int, max_nodes: int, max_bytes: int) -> Expansion:
    """Seeds and what they reach, level by level, each node once.

    `visible` holds the structure nodes that the caller may see, `everything` those of the active versions. Seeds spend bytes
    only; related nodes spend the node budget too. Once a budget stops a level, no further one is begun; the payload of a node
    that is too large is skipped and the next one tried. Nodes of others' scopes are counted, not named; nodes that aren't there
    are gaps.
    """
    spark, out = visible.sparkSession, Expansion()
    current = list(dict.fromkeys(seeds))
    attempted, level, related = set(current), 0, 0
    known = visible.select("node_id", payload_bytes(visible).alias("size"), F.transform("references", lambda r: r["target_node_id"]).alias("targets"), "gaps")
    while current:
        asked = F.broadcast(spark.createDataFrame([(n, k) for k, n in enumerate(current)], "node_id string, place int"))
        found = {r.node_id: r for r in known.join(asked, "node_id").collect()}
        absent = [n for n in current if n not in found]
        if absent:
            held = {r.node_id for r in everything.select("node_id").join(F.broadcast(spark.createDataFrame([(n,) for n in absent], "node_id string")), "node_id").collect()}
            out.denied += len(held)
            out.gaps += [(n, "malformed") for n in absent if n not in held]
        rows = [found[n] for n in current if n in found]
        kept, why = take_by_bytes([(r.node_id, r["size"]) for r in rows], max_nodes - related if level else len(rows), max_bytes - out.bytes_returned)
        for node in kept:
            out.depth[node] = level
            out.bytes_returned += found[node]["size"]
            out.gaps += [(g.text, g.reason) for g in found[node].gaps or ()]
        related += len(kept) if level else 0
        out.reasons += list(why)
        out.dropped += sum(why.values())
        following = list(dict.fromkeys(t for r in rows for t in r.targets or () if t not in attempted))
        if why:
            break
        if level >= max_depth:
            if max_depth and following:
                out.reasons.append("depth_limit")
                out.dropped += len(following)
                out.depth_limit = max_depth
            break
        attempted |= set(following)
        current, level = following, level + 1
    out.gaps = list(dict.fromkeys(out.gaps))
    return out


def related_ids(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds to each hit the ids that its node reads and that the answer holds, in order."""
    reads = nodes.select("node_id", F.explode("references").alias("r")).select("node_id", F.col("r.target_node_id").alias("target"))
    held = reads.join(F.broadcast(nodes.select(F.col("node_id").alias("target"))), "target", "left_semi")
    found = held.groupBy("node_id").agg(F.array_sort(F.collect_set("target")).alias("related_node_ids"))
    return hits.join(F.broadcast(found), "node_id", "left").withColumn("related_node_ids", F.coalesce("related_node_ids", F.array().cast("array<string>")))
