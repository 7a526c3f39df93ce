"""Connected components of a large graph: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.session import materialize


def stars(edges: DataFrame) -> DataFrame:
    """One round on edges (a, b) with a > b: all neighbours of a node meet at its least neighbour.

    Least neighbours are found by an aggregate with partial sums and joined back, so a node with
    very many neighbours does not gather them in one task.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    large = materialize(large.distinct(), "large-star")
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m")
    small = small.select(F.col("x").alias("a"), F.col("m").alias("b"))
    return materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the least node of its component."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialize(edges, "links")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state:
            break
        state, edges = now, stars(edges)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
