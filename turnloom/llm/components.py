"""Connected components by alternating stars; every step is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.session import durable


def _least(pairs: DataFrame) -> DataFrame:
    """``u, least``; stored, so that the join behind it can split a node with very many pairs."""
    return durable(pairs.groupBy("u").agg(F.min("v").alias("least")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    joined = pairs.join(_least(pairs), "u").where("v > u")
    return joined.select(F.col("v").alias("a"), F.least("u", "least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = _least(pairs)
    kept = pairs.join(least, "u").where("v <> least").select(F.col("v").alias("a"), F.col("least").alias("b"))
    return kept.unionByName(least.select(F.col("u").alias("a"), F.col("least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) for every node of ``edges(a, b)`` that is not itself the least.

    Direction, repeats and loops do not matter; edges with a null end are ignored. Rounds grow with the logarithm of
    the number of nodes. Nothing comes to the driver but a count and a checksum per round.
    """
    edges = durable(edges.where("a <> b").select("a", "b").distinct())

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return row.n, row.s

    seen = None
    while (now := mark(edges)) != seen:
        seen = now
        if not now[0]:
            break
        edges = durable(_small_star(durable(_large_star(edges))))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
