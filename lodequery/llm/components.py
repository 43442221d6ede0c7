"""Connected components of a graph given by its edges, in rounds of large-star and small-star.

Large-star points every larger neighbour of a node at the least of its neighbours and itself, small-star
every smaller one; after a few rounds each node points at the least of its component. A round is two
partial minima and two joins on the node, which adaptive execution splits where a node has very many edges.
Each round is written to the shared folder, so lineage stays short and lost executors cost one round.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.llm.shared import written


def _star(edges: DataFrame) -> DataFrame:
    """(v, least of u's neighbours and u) for directed edges (u, v), with u itself, where they differ."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    pointed = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return pointed.unionByName(own).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: long columns a and b, in any direction and repeated at will. A row per node that has an edge: ``node``, ``component`` (its least node)."""
    now = written(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        # Large-star: u's neighbours above u move to the least of all its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        now = written(_star(large), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
