"""Connected components of a link table by repeated contraction: all shuffles,
no link or component reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """links(a, b) -> (node, component) of every node with a link to another;
    a component is named by one of its nodes.

    A round moves every node to the least of itself and its neighbours, in an
    order drawn anew by hash, and keeps the links between the places moved to.
    Nodes shrink by a constant share a round, chains too; when no link is left
    the moves, applied from last to first, name the components."""
    edges = stash(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), tag)
    moves: list[DataFrame] = []
    while edges.limit(1).count():
        order = lambda c, k=len(moves): F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("to"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        move = stash(least.select(F.col("a").alias("node"), F.least(F.col("m"), order("a"))["to"].alias("to")), tag)
        moves.append(move)
        moved = edges.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(
            move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = stash(moved.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), tag)
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = moves.pop().withColumnRenamed("to", "component")
    for move in reversed(moves):
        later = found.select(F.col("node").alias("to"), "component")
        found = move.join(later, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    return found
