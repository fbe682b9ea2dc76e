"""Connected components by alternating stars, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, table


#: Parts that the neighbours of a node are dealt to.
SALTS = 64


def _round(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (a, b): every node's neighbours (large: the greater ones; small: the smaller ones and itself) link to the least.

    A node's neighbours are dealt by a hash to parts, and no key is without its part where all of them
    move: the least of each part is found, the least of those for the node, and it goes back to the parts.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = both.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    parts = both.groupBy("a", "s").agg(F.min("b").alias("m"))
    least = parts.groupBy("a").agg(F.min("m").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    parts = parts.select("a", F.col("s").alias("t")).join(least, F.col("a") == F.col("n")).select("n", "t", "m")
    out = both.join(parts, (F.col("a") == F.col("n")) & (F.col("s") == F.col("t")))
    if large:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a node that has no other to one that has none: then b is a's component."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("top")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("top").alias("top")).where("down + top > 1").isEmpty()


def components(edges: DataFrame, spark: SparkSession, most_rounds: int = 50) -> DataFrame:
    """node, component for every node of edges (a, b: long); a component's name is its least node.

    Each round's edges are a table; it ends when every edge leads from a node to its component. A node with
    very many neighbours is in no task with more than one of their SALTS parts.
    """
    edges = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), spark)
    for _ in range(most_rounds):
        if _settled(edges):
            break
        before, edges = edges, table(_round(_round(edges, large=True), large=False), spark)
        drop(before, spark)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
