"""Connected components of a sparse graph, as rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators.skew import lookup_join
from storyloom.session import durable


def _moved(edges: DataFrame, parents: DataFrame, side: str, other: str) -> DataFrame:
    """Replace ``side`` by its parent. A hub may end a large part of all edges, so hot nodes are dealt out."""
    found = lookup_join(edges, parents.withColumnRenamed("node", side), side, [other])
    return found.select(F.col("parent").alias(side), other)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node that it is linked with.

    Each round hooks every node to its smallest neighbour and contracts; self links and repeated links
    disappear, so the edges left shrink fast. A component's smallest node hooks to itself in every round
    and so names it in the end. Edges never leave the executors; every step is checkpointed, so plans stay
    as small as one step. Loops and nulls are ignored; the result of no edges is empty.
    """
    left = durable(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct())
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(
            left.select(F.col("b").alias("node"), F.col("a").alias("to"))
        )
        parents = durable(both.groupBy("node").agg(F.least("node", F.min("to")).alias("parent")))
        rounds.append(parents)
        one = durable(_moved(left, parents, "a", "b").filter(F.col("a") != F.col("b")).distinct())
        moved = _moved(one, parents, "b", "a").filter(F.col("a") != F.col("b"))
        left = durable(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    found = rounds[0].select("node", F.col("parent").alias("root"))
    for parents in rounds[1:]:
        step = lookup_join(found, parents.withColumnRenamed("node", "root"), "root", ["node"])
        found = durable(step.select("node", F.coalesce("parent", "root").alias("root")))
    return found
