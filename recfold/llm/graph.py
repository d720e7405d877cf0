"""Connected components by alternating large-star and small-star rounds over written edge tables.

A round is two aggregations and joins on a node. The least neighbour of a node is found by a
pre-aggregated minimum, which is written, and rows meet it in a join that may split a hot node, so a hub that a third
of all nodes hang on is never gathered in one task. Nothing is collected but an edge count and a
checksum per round. Rounds end when the edges no longer change; they are stars then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("least")), "least")
    out = down.join(least, "u").filter("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return out.union(least.select("u", F.col("least").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in an edge (u, v); the root is the component's least node. Self-loops and repeats are allowed."""
    edges = written(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if not now[0] or now == seen:
            break
        seen = now
        edges = written(_small_star(written(_large_star(edges), "edges")), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
