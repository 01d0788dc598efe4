"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import materialise, release


def _large_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every neighbour above a node is linked to the least of the node's neighbourhood. Also returns the written least ones: the
    join is then one of two plain scans, which AQE can split where a centre is hot."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _small_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node and its neighbours below are linked to the least of them. Needs u > v."""
    least = materialise(e.groupBy("u").agg(F.min("v").alias("m")), "least")
    down = e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct(), least


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Component of every node that has an edge.

    ``edges``: two integer columns (any names). Returns ``node``, ``component_id`` (the least node of
    the component) for nodes with at least one edge to another node. Self-loops, repeated edges and
    edges with a null end add nothing; an empty table gives an empty table. Work per round is two
    aggregations with map-side combine and two joins that AQE may split; edges never reach the driver
    (one count and one sum do, to see whether a round changed anything).
    """
    a, b = (F.col(c).cast("long") for c in edges.columns[:2])
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v and v is not null").distinct()
    e = materialise(e, "edges")
    seen = None
    for _ in range(max_rounds):
        star, one = _large_star(e)
        wide = materialise(star, "large-star")
        star, two = _small_star(wide)
        before, e = e, materialise(star, "small-star")
        release(before, wide, one, two)
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == seen:
            stars = e.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
            return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
