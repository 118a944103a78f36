"""Connected components of an edge table, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` for every end of an edge ``(a, b)``; component is the smallest node.

    Each round points every node at its smallest neighbour, follows pointers to
    the roots by doubling, and contracts the edges onto the roots.  Edges shrink
    by at least half of the nodes a round.  Loops and nulls are ignored.
    """
    e = scratch.table(
        edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("a is not null and b is not null and u < v").distinct(),
        "edges",
    )
    rounds: list[DataFrame] = []
    while n := e.count():  # nodes are at most twice as many, and no later table is larger
        both = e.select(F.col("u").alias("node"), F.col("v").alias("other")).unionAll(e.select(F.col("v"), F.col("u")))
        up = scratch.table(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("up")), "up", 2 * n)
        while True:
            top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = scratch.table(up.join(top, "up").select("node", F.col("top").alias("up"), (F.col("top") < F.col("up")).alias("moved")), "jump", 2 * n)
            up = jumped.select("node", "up")
            if jumped.filter("moved").isEmpty():
                break
        rounds.append(up)
        left = up.select(F.col("node").alias("u"), F.col("up").alias("pu"))
        right = up.select(F.col("node").alias("v"), F.col("up").alias("pv"))
        e = scratch.table(
            e.join(left, "u").join(right, "v").filter("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(),
            "edges",
            n,
        )
    if not rounds:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    label = rounds[-1].select("node", F.col("up").alias("component"))
    for up in reversed(rounds[:-1]):
        above = label.select(F.col("node").alias("up"), "component")
        label = up.join(above, "up", "left").select("node", F.coalesce("component", "up").alias("component"))
    return label
