"""Connected components by alternating large-star and small-star steps, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import Scratch


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Connect neighbours of every node to the smallest node around it."""
    if larger:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        moved = F.col("v") > F.col("u")
    else:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        around, moved = around.unionByName(around.select("u", F.col("u").alias("v"))), F.lit(True)
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    linked = around.join(least, "u").where(moved & (F.col("v") != F.col("m")))
    return linked.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def connected(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    Ends when a round leaves the edges as they were: then every node hangs on its root.
    """
    current, before, turn = edges, None, 0
    while True:
        name = f"{label}-{turn}"
        current = scratch.write(_star(_star(current, True), False), name)
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if turn:
            scratch.drop(f"{label}-{turn - 1}")
        if tuple(state) == before:
            stars = current.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return stars.unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before, turn = tuple(state), turn + 1
