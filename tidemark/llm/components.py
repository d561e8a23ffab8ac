"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _starred(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over (a, b) with a > b: connect neighbours to the least neighbour."""
    if small:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
        out = out.select("e.a", "e.b")
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges: a round that leaves it as it was has settled."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of (a, b) edges of longs; root is the least node reachable.

    Every round is two joins over the edges and is stored, so a lost executor costs one round. Hubs
    are reduced by map-side minima, and their joins can be split by Spark. Self edges are ignored.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    seen = _mark(edges)
    for _ in range(rounds):
        edges = stored(_starred(_starred(edges, small=False), small=True), "edges")
        mark = _mark(edges)
        if mark == seen:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = mark
    raise RuntimeError("components did not settle; raise rounds")
