"""Knowledge-graph tables (G1-G8): regions, nodes, links, counts and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators.ordering import numbered, numbered_within

SUMMARY, DESCRIPTION, LINK, RECENT = 400, 300, 160, 12


def clip(text: F.Column, most: int) -> F.Column:
    text = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def top_regions(communities: DataFrame, reports: DataFrame) -> DataFrame:
    """G1: communities of the lowest level in order, with their report, if any, and member count."""
    low = communities.agg(F.min("level").alias("_low"))
    top = communities.crossJoin(F.broadcast(low)).filter(F.col("level") == F.col("_low")).drop("_low")
    r = reports.groupBy("community").agg(F.max(F.struct("title", "summary", "rank")).alias("r"))
    rows = top.withColumnRenamed("title", "_title").join(r, "community", "left")
    return numbered(rows, ["community"], "_nth").select((F.col("_nth") - 1).cast("int").alias("region"), "community", F.coalesce("r.title", "_title").alias("title"), F.round("r.rank", 1).alias("rank"), clip(F.col("r.summary"), SUMMARY).alias("summary"), F.coalesce(F.size("entity_ids"), F.lit(0)).alias("members"), "entity_ids")


def graph_nodes(entities: DataFrame, regions: DataFrame) -> DataFrame:
    """Entities with defaults and the first region that holds them (-1: none)."""
    of = regions.select("region", F.explode("entity_ids").alias("id")).groupBy("id").agg(F.min("region").alias("region"))
    return entities.join(of, "id", "left").select("id", "title", F.coalesce(F.nullif("type", F.lit("")), F.lit("UNKNOWN")).alias("type"), clip(F.col("description"), DESCRIPTION).alias("description"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("frequency", F.lit(0)).alias("frequency"), F.coalesce("region", F.lit(-1)).alias("region"))


def graph_links(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships between titles that exist; of repeated titles the last entity (by position) counts."""
    last = entities.groupBy("title").agg(F.max("position").alias("position"))
    s, g = last.toDF("source", "source_position"), last.toDF("target", "target_position")
    return relationships.join(s, "source").join(g, "target").select("source_position", "target_position", F.round(F.coalesce("weight", F.lit(0.0)), 2).alias("weight"), clip(F.col("description"), LINK).alias("description"))


def type_counts(entities: DataFrame) -> DataFrame:
    """Entities a type, most first."""
    return entities.groupBy(F.coalesce(F.nullif("type", F.lit("")), F.lit("UNKNOWN")).alias("type")).agg(F.count(F.lit(1)).alias("entities")).orderBy(F.desc("entities"), "type")


def graph_stats(log: DataFrame | None = None, **tables: DataFrame) -> DataFrame:
    """One row with the size of each table, and of the log's total and completed queries."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)
    if log is not None:
        out = out.crossJoin(log.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("status") == "COMPLETED").alias("completed")))
    return out


def graph_alerts(nodes: DataFrame, regions: DataFrame, recent: DataFrame) -> DataFrame:
    """(severity, kind, n, example): unfinished queries, isolated entities, regions without report, entities without region."""
    rows = [
        recent.filter("status <> 'COMPLETED' or status is null").select(F.lit(0).alias("severity"), F.lit("query").alias("kind"), F.lit(1).cast("long").alias("n"), F.col("question").alias("example")),
        nodes.filter("degree = 0").agg(F.count(F.lit(1)).alias("n"), F.min_by("title", "id").alias("example")).select(F.lit(1).alias("severity"), F.lit("isolated").alias("kind"), "n", "example").filter("n > 0"),
        regions.filter("rank is null").agg(F.count(F.lit(1)).alias("n"), F.min_by("title", "region").alias("example")).select(F.lit(1).alias("severity"), F.lit("unreported").alias("kind"), "n", "example").filter("n > 0"),
        nodes.filter("region = -1").agg(F.count(F.lit(1)).alias("n")).crossJoin(regions.agg(F.count(F.lit(1)).alias("r"))).filter("n > 0 and r > 0").select(F.lit(2).alias("severity"), F.lit("frontier").alias("kind"), "n", F.lit("").alias("example")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.orderBy("severity", "kind", "example")


def recent_queries(log: DataFrame, n: int = RECENT) -> tuple[DataFrame, DataFrame]:
    """(total and completed queries; the last n records by ordinal, newest first)."""
    total = log.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "COMPLETED").alias("completed"))
    last = log.orderBy(F.desc("ordinal")).limit(n).select("ordinal", clip(F.col("question"), 80).alias("question"), "method", "status", F.coalesce("completed_at", "started_at").alias("at"), "duration_seconds")
    return total, last


def hubs(nodes: DataFrame, n: int = 8) -> DataFrame:
    """The entities of highest degree."""
    return nodes.orderBy(F.desc("degree"), "id").limit(n)


def neighbours(links: DataFrame, node: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(position, other, weight, rank): both ends of each link, heaviest first; of some positions, if given.

    With ``most``, each task keeps that many of a position before they meet; without, ranks pass over
    ranges, so the links of a hub needn't fit one task either way.
    """
    both = links.select(F.col("source_position").alias("position"), F.col("target_position").alias("other"), "weight").unionByName(links.select(F.col("target_position").alias("position"), F.col("source_position").alias("other"), "weight"))
    if node is not None:
        both = both.join(node.select("position").distinct(), "position", "left_semi")
    if most is None:
        return numbered_within(both.withColumn("_heavy", -F.col("weight")), ["position"], ["_heavy", "other"], "rank").drop("_heavy")
    rank = F.row_number().over(W.partitionBy("position").orderBy(F.desc("weight"), "other"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= most)


def region_order(regions: DataFrame) -> DataFrame:
    """Regions by rank, then size."""
    return regions.orderBy(F.desc_nulls_last("rank"), F.desc("members"), "region")


def node_summary(nodes: DataFrame) -> DataFrame:
    """Isolated entities and mean degree."""
    return nodes.agg(F.count_if(F.col("degree") == 0).alias("isolated"), F.avg("degree").alias("average_degree"))
