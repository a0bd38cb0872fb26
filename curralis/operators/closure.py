"""Bounded closures: the nodes within so many steps of each root, with the least number of steps.

Paths are never enumerated. bfs() keeps a frontier of (root, node) pairs that were not reached before, a level at a time;
levels are kept in the checkpoint folder, so that lost executors lose none, and it stops at the first empty level. recursive() is
one recursive SQL query without driver steps, for edges whose number of paths is known to be small (partonomy).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curralis.plans.lineage import counted, settled
from curralis.schema import MAX_DEPTH


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def bfs(seeds: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, node, depth) of everything reached from seeds (root, node) along edges (source, target); seeds have depth 0."""
    steps = settled(edges.select("source", "target").distinct())
    level = settled(seeds.select("root", "node").distinct())
    out, depth = level.withColumn("depth", F.lit(0)), 0
    while depth < max_depth:
        depth += 1
        ahead = level.join(steps, level.node == steps.source).select("root", F.col("target").alias("node")).distinct()
        # each level is cut off from the plans before it, so that the plan of the next stays as small as this one's
        level, n = counted(ahead.join(out.select("root", "node"), ["root", "node"], "left_anti"))
        if not n:
            break
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out


def recursive(seeds: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """As bfs(), by a recursive common table: enumerates paths, so only for edges with few of them."""
    return seeds.sparkSession.sql(
        """WITH RECURSIVE reach(root, node, depth) AS (
             SELECT root, node, 0 FROM {seeds}
             UNION ALL
             SELECT r.root, e.target, r.depth + 1 FROM reach r JOIN {edges} e ON e.source = r.node WHERE r.depth < {depth})
           SELECT root, node, min(depth) AS depth FROM reach GROUP BY root, node""",
        seeds=seeds.select("root", "node").distinct(), edges=edges.select("source", "target").distinct(), depth=max_depth,
    )


def unrolled(seeds: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """As bfs(), as one lazy plan of max_depth joins: for short bounds. Paths collapse to distinct pairs after each join."""
    steps = edges.select("source", "target").distinct()
    level = seeds.select("root", "node").distinct()
    out = level.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        level = level.join(steps, level.node == steps.source).select("root", F.col("target").alias("node")).distinct()
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out.groupBy("root", "node").agg(F.min("depth").alias("depth"))


#: A concept lies in a topic, a topic in a unit, a unit in an area: chains are this long at most.
PARTONOMY_DEPTH = 3


def partonomy(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    return unrolled(seeds, edges, PARTONOMY_DEPTH)
