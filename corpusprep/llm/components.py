"""Connected components by rounds of contraction, each a few joins on the edges left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.sources.scratch import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; equal roots mean connected.

    In a round each node points to the neighbour, or itself, with the smallest
    scrambled value, and edges move to where their ends point. The scrambling
    changes from round to round, so paths shrink by a constant factor however
    nodes are numbered. Tables of each round are written, which cuts lineage;
    the driver learns only whether edges are left.
    """
    left = materialize(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        rank = lambda node, r=len(rounds): F.struct(
            F.xxhash64(node, F.lit(r)).alias("rank"), F.col(node).alias("node")
        )
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            left.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        nearest = ends.groupBy("node").agg(F.min(rank("other")).alias("near"))
        to = F.least(F.col("near"), rank("node"))["node"]
        points = materialize(nearest.select("node", to.alias("to")), "points")
        rounds.append(points)
        of = lambda name: points.select(F.col("node").alias(name), F.col("to").alias(f"{name}_to"))
        moved = left.join(of("a"), "a").join(of("b"), "b").select(
            F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")
        )
        left = materialize(moved.where(F.col("a") != F.col("b")).distinct(), "edges")
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds.pop().select("node", F.col("to").alias("root"))
    while rounds:
        later = roots.select(F.col("node").alias("to"), "root")
        roots = (
            rounds.pop()
            .join(later, "to", "left")
            .select("node", F.coalesce("root", "to").alias("root"))
        )
    return roots
