"""Arc views of an edge table ``(edge, src, dst, directed, cost)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

DIRECTIONS = ("forward", "backward", "both")


def arcs(edges: DataFrame, direction: str = "forward") -> DataFrame:
    """``edge, src, dst, cost, sign``: one arc for a directed edge, two for an undirected one.

    ``backward`` turns every arc round, ``both`` lets every edge be walked either way.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    along = edges.select("edge", "src", "dst", "cost", F.lit(1).alias("sign"))
    against = edges.select("edge", F.col("dst").alias("src"), F.col("src").alias("dst"), "cost", F.lit(-1).alias("sign"))
    if direction == "both":
        return along.unionAll(against)
    two_way = edges.filter(~F.col("directed")) if "directed" in edges.columns else edges
    back = two_way.select("edge", F.col("dst").alias("src"), F.col("src").alias("dst"), "cost", F.lit(-1).alias("sign"))
    forward = along.unionAll(back)
    return forward if direction == "forward" else forward.select("edge", F.col("dst").alias("src"), F.col("src").alias("dst"), "cost", (-F.col("sign")).alias("sign"))
