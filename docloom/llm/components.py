"""Connected components of an edge table by alternating large and small stars.

Every step is a minimum per node and a join, both of which Spark combines or splits for hot nodes; no
neighbour list is ever collected. Minima are written before they are joined, so that both sides of the join
are exchanges of their own and Spark can split a hot node. Each round is written to the shared folder, so
lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import discard, materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    return _both_ways(edges).join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(down: DataFrame, least: DataFrame) -> DataFrame:
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the edges (a, b); ``root`` is the least node of its component."""
    edges = materialise(edges.where("a <> b"), "edges")
    before = None
    for _ in range(rounds):
        near = materialise(_both_ways(edges).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        down = materialise(_large_star(edges, near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "down")
        least = materialise(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = materialise(_small_star(down, least), "stars")
        discard(edges, near, down, least)
        edges = moved
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(hash(b, a))")).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no convergence in {rounds} rounds")
    found = materialise(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "components")
    discard(edges)
    return found
