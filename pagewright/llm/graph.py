"""Connected components over a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_paths, last_path, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of a node goes to the node's least neighbour. Small: every
    smaller one, and the node itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "n")
    joined = both.join(least, both["a"] == least["n"])
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of `edges` (a long, b long); root is the least node reachable.

    Each round halves path lengths and writes its table to shared storage, so neither lineage nor
    what the driver holds grows. Nodes without edges do not appear; loops are ignored. A star with
    very many leaves is only ever pre-aggregated (its least neighbour) and joined back, a join whose
    large partitions adaptive execution may split.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    old, mark = last_path(), None
    for _ in range(most_rounds):
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        large = stored(_star(edges, True), "large-star")
        done = [old, last_path()]
        edges = stored(_star(large, False), "small-star")
        drop_paths(edges.sparkSession, done)
        old = last_path()
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
