"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import store


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour at the smallest node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node, component` for every node of an edge that is not the smallest of its own.

    `component` is the smallest node that can be reached. Nodes that are missing from the
    result are their own component. Edges to oneself and edges with a null end are
    ignored, repeated ones count once. Every round writes a table in the shared folder;
    the driver sees two numbers a round. A node with very many edges is split by
    adaptive execution, because minima are aggregated before they are joined.
    """
    edges = store(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state[0] == 0 or state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
        edges = store(_small_star(_large_star(edges)), "edges")
