"""Row numbers, neighbours and carried values in an order, without one task that sees all rows of a table or of a key.

Rows are dealt to ranges of the order; windows run within a range, and what passes from range to range
is one row for each range and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.sources.scratch import kept


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with ``name``: 1, 2, .. in the order of ``by``: within ranges, on from the sizes of the ranges before."""
    placed = kept(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    # one number a range
    sizes = sorted((r["_range"], r["n"]) for r in placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    before = F.broadcast(df.sparkSession.createDataFrame(starts, "_range int, _before long"))
    nth = F.row_number().over(W.partitionBy("_range").orderBy(*by))
    return placed.join(before, "_range").withColumn(name, F.col("_before") + nth).drop("_range", "_before")


def placed(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with ``_range``: the number of the range of (by, order) that a row is in; equal rows share one."""
    return kept(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))


def _met(rows: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of edges(_range, *by, ..) of their range and key."""
    named = edges.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], *[c for c in edges.columns if c not in ("_range", *by)])
    same = F.col("_range") == F.col("_r")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{k}"))
    return rows.join(named, same, "left").drop("_r", *[f"_by{k}" for k in range(len(by))])


def with_neighbours(ranged: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``_before`` and ``_after``: structs of ``columns`` of the row before and after in the order within a key; null at its ends."""
    cell, at = F.struct(*columns), F.struct(*order)
    edges = ranged.groupBy("_range", *by).agg(F.min_by(cell, at).alias("_first"), F.max_by(cell, at).alias("_last"))
    across = W.partitionBy(*by).orderBy("_range")
    edges = edges.select("_range", *by, F.lag("_last").over(across).alias("_from"), F.lead("_first").over(across).alias("_to"))
    inside = W.partitionBy("_range", *by).orderBy(*order)
    rows = ranged.withColumn("_before", F.lag(cell).over(inside)).withColumn("_after", F.lead(cell).over(inside))
    return _met(rows, edges, by).withColumn("_before", F.coalesce("_before", "_from")).withColumn("_after", F.coalesce("_after", "_to")).drop("_from", "_to")


def carried(ranged: DataFrame, by: list[str], order: list[str], value: str, name: str, own: bool = False) -> DataFrame:
    """``name``: the last value that is not null, of the rows before within a key (``own``: and the row itself)."""
    edges = ranged.groupBy("_range", *by).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    before = F.last("_end", True).over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    edges = edges.select("_range", *by, before.alias("_from"))
    inside = W.partitionBy("_range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow if own else -1)
    rows = ranged.withColumn(name, F.last(value, True).over(inside))
    return _met(rows, edges, by).withColumn(name, F.coalesce(name, "_from")).drop("_from")


def numbered_within(df: DataFrame, by: list[str], order: list[str], name: str, size: str | None = None) -> DataFrame:
    """``name``: 1, 2, .. in the order within each key; ``size``: a column for the number of rows of the key."""
    ranged = placed(df, by, order)
    edges = ranged.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_n"))
    across = W.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(across.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = edges.select("_range", *by, before.alias("_from"), F.sum("_n").over(across).alias("_size"))
    nth = F.row_number().over(W.partitionBy("_range", *by).orderBy(*order))
    rows = _met(ranged.withColumn("_nth", nth), edges, by).withColumn(name, F.col("_from") + F.col("_nth"))
    return (rows.withColumn(size, F.col("_size")) if size else rows).drop("_range", "_nth", "_from", "_size")


def _with_bounds(rows: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """rows(*by, _v) with their group's bounds(*by, n, lo, hi, rank), of those within them."""
    named = bounds.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], "n", "lo", "hi", "rank")
    same = F.lit(True)
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{k}"))
    small = F.broadcast(named) if named.limit(10_001).count() <= 10_000 else named
    return rows.join(small, same).filter(F.col("_v").between(F.col("lo"), F.col("hi")))


def nearest_rank(df: DataFrame, by: list[str], column: str, share: float, name: str, few: int = 100_000, buckets: int = 4096) -> DataFrame:
    """(*by, name): of each group the value at the rank ceil(share * count) of those that are known and finite.

    Exact by rounds: a round counts a group's values in equal steps between its bounds and goes on within
    the step that holds the rank, until the bounds meet or ``few`` values are left, which are sorted. No
    round sends more than ``buckets`` counts a group and task, so a group of any size fits.
    """
    known = F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") != float("inf"))
    rows = df.select(*by, F.col(column).cast("double").alias("_v")).filter(known)
    found = F.when(F.col("rank") <= 1, F.col("lo")).when((F.col("rank") == F.col("n")) | (F.col("lo") == F.col("hi")), F.col("hi"))
    live = kept(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).withColumn("rank", F.ceil(F.col("n") * share)))
    out = live.filter(found.isNotNull()).select(*by, found.alias(name))
    while True:
        live = live.filter(found.isNull())
        small, large = live.filter(F.col("n") <= few), kept(live.filter(F.col("n") > few))
        if small.head(1):
            nth = F.row_number().over(W.partitionBy(*by).orderBy("_v"))
            out = out.unionByName(_with_bounds(rows, small, by).withColumn("_nth", nth).filter("_nth = rank").select(*by, F.col("_v").alias(name)))
        if not large.head(1):
            return out
        # halves, as the width of all doubles has no double; whole for widths that have no half
        half, low = F.col("hi") / 2 - F.col("lo") / 2, F.col("lo")
        part = F.when(half > 0, F.try_divide(F.col("_v") / 2 - low / 2, half)).otherwise(F.try_divide(F.col("_v") - low, F.col("hi") - low))
        step = F.floor(part * buckets)
        cells = _with_bounds(rows, large, by).groupBy(*by, F.least(step, F.lit(buckets - 1)).alias("_step")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.first("rank").alias("rank"))
        upto = F.sum("n").over(W.partitionBy(*by).orderBy("_step"))
        inside = cells.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("rank")) & (F.col("_upto") - F.col("n") < F.col("rank")))
        live = kept(inside.select(*by, "n", "lo", "hi", (F.col("rank") - (F.col("_upto") - F.col("n"))).alias("rank")))
        out = out.unionByName(live.filter(found.isNotNull()).select(*by, found.alias(name)))
