"""Causal and waterway graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut


def reachable(edges: DataFrame, key: str = "entity", src: str = "src", dst: str = "dst") -> DataFrame:
    """Transitive closure ``(key, src, dst)``; cycles are fine, and a node on one reaches itself.

    Path doubling: every round joins paths to paths, so the rounds grow with the
    logarithm of the longest path.
    """
    paths = cut(edges.select(key, F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    n = paths.count()
    while True:
        more = paths.select(key, "src", F.col("dst").alias("mid")).join(paths.select(key, F.col("src").alias("mid"), "dst"), [key, "mid"]).select(key, "src", "dst")
        paths = cut(paths.unionByName(more).distinct())
        size = paths.count()
        if size == n:
            return paths
        n = size


def ancestors(edges: DataFrame, target, key: str = "entity") -> DataFrame:
    """``(key, target, node)`` of every node with a path to the target, the target itself left out.

    ``target`` is a node, or a table ``(key, target)``.  Edges are walked
    backwards, one join a step: the work follows the nodes found, not all pairs.
    """
    links = cut(edges.select(key, "src", "dst").distinct())
    goals = target if isinstance(target, DataFrame) else links.select(key).distinct().withColumn("target", F.lit(target))
    found = front = cut(goals.select(key, "target", F.col("target").alias("node")).distinct())
    while True:
        above = links.join(front.withColumnRenamed("node", "dst"), [key, "dst"]).select(key, "target", F.col("src").alias("node")).distinct()
        front = cut(above.join(found, [key, "target", "node"], "left_anti"))
        if front.isEmpty():
            return found.filter("node <> target")
        found = cut(found.unionByName(front))


def components(edges: DataFrame, key: str = "entity") -> DataFrame:
    """Smallest connected node of every node of an undirected edge table.

    Every round a node takes the smallest label of its neighbours, then that
    label's own label; a round reads each edge once and keeps one row a node.
    """
    both = cut(edges.select(key, "src", "dst").unionByName(edges.select(key, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = cut(both.groupBy(key, F.col("src").alias("node")).agg(F.min("dst").alias("_m")).select(key, "node", F.least("node", "_m").alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("node", "dst"), [key, "dst"]).groupBy(key, F.col("src").alias("node")).agg(F.min("component").alias("_m"))
        step = label.join(near, [key, "node"]).select(key, "node", "component", F.least("component", "_m").alias("_to"))
        jump = step.select(key, F.col("node").alias("_to"), F.col("_to").alias("_top"))
        moved = cut(step.join(jump, [key, "_to"]).select(key, "node", F.col("_top").alias("component"), (F.col("_top") < F.col("component")).alias("_moved")))
        label = moved.select(key, "node", "component")
        if moved.filter("_moved").isEmpty():
            return label


def upstream(pointers: DataFrame, outlet, node: str = "node", down: str = "down") -> DataFrame:
    """All nodes draining to the outlet along ``down`` pointers, the outlet included."""
    found = cut(pointers.filter(F.col(node) == outlet).select(node))
    edge = found
    while not edge.isEmpty():
        above = pointers.join(edge.select(F.col(node).alias(down)), down, "left_semi").select(node).distinct()
        edge = cut(above.join(found, node, "left_anti"))
        found = cut(found.unionByName(edge))
    return found


def separation_tier(direct, same_component, same_system) -> F.Column:
    return F.when(direct, "1 direct").when(same_component, "2 same component").when(same_system, "3 same system").otherwise("4 different system")
