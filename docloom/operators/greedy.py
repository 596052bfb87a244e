"""Greedy choice in an order, as rounds of joins.

``edges(first, later)``: rows that exclude each other, the one that comes earlier in the order first. In
the order, a row stays unless an earlier one that stays excludes it. A row that no undecided row can
exclude is safe, and drops all that it excludes; what is left is decided in further rounds. Rounds follow
the longest chain of rows that each wait for the one before; none holds a list of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.scratch import written


def excluded(edges: DataFrame) -> DataFrame:
    """(row, by): the rows that go, with the earliest row that stays and excludes them. Rows must be comparable by order."""
    edges = written(edges.select("first", "later").distinct(), "edges")
    live, gone = edges, None
    while live.head(1):
        safe = live.select("first").distinct().join(live.select(F.col("later").alias("first")), "first", "left_anti")
        drop = written(live.join(safe, "first", "left_semi").select(F.col("later").alias("row")).distinct(), "dropped")
        gone = drop if gone is None else gone.unionByName(drop)
        live = live.join(drop.withColumnRenamed("row", "first"), "first", "left_anti").join(drop.withColumnRenamed("row", "later"), "later", "left_anti").select("first", "later")
        live = written(live, "undecided")
    if gone is None:
        return edges.select(F.col("later").alias("row"), F.col("first").alias("by"))
    stay = edges.join(gone.withColumnRenamed("row", "first"), "first", "left_anti")
    return stay.join(gone.withColumnRenamed("row", "later"), "later", "left_semi").groupBy(F.col("later").alias("row")).agg(F.min("first").alias("by"))
