"""Connected components by contraction, as DataFrame joins.

Every round each vertex points to its smallest neighbour or itself, pointers are followed once more,
and the edges are rewritten between the vertices pointed to: the graph shrinks by half or more, so
rounds grow with the logarithm of the longest chain. Each round is cut with written tables (after a
checkpoint the planner's size estimates multiply from round to round), in as many partitions as
their rows need. Null ends and self loops are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.scratch import written

ROWS = 100_000  # a partition of a round's tables


def kept(df: DataFrame) -> DataFrame:
    return written(df, "components")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices(fp), edges(a, b) -> (fp, component): component is the smallest fp that is reachable.

    Only ends of edges take part in the rounds; other vertices are their own component.
    """
    live = kept(edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n, labels = live.count(), None
    while n:
        parts = 1 + n // ROWS
        ends = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # pointers only fall, so they form a forest
        point = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).select(F.col("a").alias("v"), "to")
        hop = point.toDF("_v", "_to")
        point = kept(point.join(hop, F.col("to") == F.col("_v")).select("v", F.col("_to").alias("to")).coalesce(2 * parts))
        now, other = point.toDF("_v", "_to"), point.toDF("_w", "_u")
        labels = point if labels is None else labels.join(now, F.col("to") == F.col("_v"), "left").select("v", F.coalesce("_to", "to").alias("to"))
        moved = live.join(now, F.col("a") == F.col("_v")).join(other, F.col("b") == F.col("_w"))
        live = kept(moved.select(F.least("_to", "_u").alias("a"), F.greatest("_to", "_u").alias("b")).filter("a <> b").distinct().coalesce(parts))
        n = live.count()
    if labels is None:
        return kept(vertices.select("fp", F.col("fp").alias("component")))
    return kept(vertices.join(labels, F.col("fp") == F.col("v"), "left").select("fp", F.coalesce("to", "fp").alias("component")))
