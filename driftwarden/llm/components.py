"""Connected components by alternating large-star and small-star steps.

Every step is an aggregate that combines on the map side and a join on the same key, so a node with
a third of all edges is neither collected nor held by one task (the aggregate is written before the join, whose
shuffles Spark can then split). The edge list is written to the shared
folder after each round: lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftwarden.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` undirected edges to ``(node, root)``, root being the least node reachable.

    Roots have no row of their own; loops are ignored, repeated edges count once, an edge with a NULL end is dropped,
    and no edges give no rows.
    """
    stars = materialize(_small_star(edges.where("u <> v")), "stars")
    while True:
        rows, sources = stars.agg(F.count("*"), F.count_distinct("u")).first()
        chained = stars.select("v").join(stars.select(F.col("u").alias("v")), "v", "left_semi")
        if rows == sources and chained.isEmpty():
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        stars = materialize(_small_star(_large_star(stars)), "stars")
