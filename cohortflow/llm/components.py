"""Connected components of an edge table by alternating large-star and small-star rounds.

Edges never leave Spark: each round is a few joins and groupings whose
result is written as a reliable checkpoint, and only the counters that tell
whether a round changed anything reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links neighbours of each node to the smallest node around it.

    large: the neighbours above the node (edges come in both directions);
    small: those below it, and the node itself. Minima are partial
    aggregates and the join on a hot node can be split, so a node with very
    many neighbours is not gathered in one task.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        out = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = (edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .union(low.select("u", F.col("m").alias("v"))))
    return out.filter("u > v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    ``edges`` has columns u and v of one orderable type, in any direction,
    with repeats and self links allowed (a self link alone gives no row).
    """
    edges = settled(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .distinct())
    before = None
    for _ in range(max_rounds):
        edges = settled(_star(_star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
