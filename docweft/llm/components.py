"""Distributed connected components by alternating large-star and small-star rounds.

Edges are never gathered in one task or on the driver: each half round is a
``min`` per node (partial aggregation before the shuffle, so a node with a third
of all edges costs one row a task) and an equi-join that adaptive execution may
split. Every round ends in a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.llm.scratch import Scratch


def _hang(edges: DataFrame) -> DataFrame:
    """(node, low): each neighbour under the least of the neighbourhood of what it touches."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    return edges.join(low, "a")


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """(node long, component long) for every node that an edge touches; component is the least node reached.

    ``edges``: columns a, b (long). Loops, both directions and repeats are
    allowed. No edges: no rows. ``most`` bounds the rounds; their number grows
    with the logarithm of the longest path.
    """
    now = scratch.keep(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: what lies above a node hangs under the least node around it.
        large = _hang(both).where("b > a").select(F.col("b").alias("a"), F.least("low", "a").alias("b")).distinct()
        # Small star: what lies below a node, and the node, hang under the least below it.
        hung = _hang(large)
        small = (
            hung.select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(hung.select("a", F.col("low").alias("b")))
            .where("a <> b")
            .distinct()
        )
        after = scratch.keep(small, "edges")
        scratch.drop(now)
        now = after
        # Stars: no node hangs twice, and no centre hangs.
        roles = now.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
            now.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
        )
        bad = roles.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or (hangs > 0 and holds > 0)")
        if bad.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
