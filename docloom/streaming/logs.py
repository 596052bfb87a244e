"""Console logs, and query logs and documents as streams (L1-L4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.sources.store import DocumentStore
from docloom.sources.tables import LOG_SCHEMA

# ---- fixed values: lines of the console log ----
PIPELINE = r"(?U)Starting pipeline with workflows:\s*(.+)"
START = r"(?U)Starting workflow:\s*(\S+)"
END = r"(?U)Workflow complete:\s*(\S+)"
ITEM = r"(?U)^\s*(\d+)\s*/\s*(\d+)\s"
# ---- end of fixed values ----


def _parsed(lines: DataFrame) -> DataFrame:
    """What each console line says: a list of workflows, one that starts or ends, or items done."""
    got = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    return lines.select("run_id", F.col("line_no").cast("long").alias("line_no"), got(PIPELINE).alias("names"), got(START).alias("start"), got(END).alias("end"), F.regexp_extract("line", ITEM, 1).try_cast("double").alias("done"), F.regexp_extract("line", ITEM, 2).try_cast("double").alias("of"))


def workflow_progress(lines: DataFrame) -> DataFrame:
    """L1: lines(run_id, line_no, line) to completed and total workflows, the current one and the fraction done.

    One aggregation of the last line of each kind, so it holds for a table and for a stream (in update
    mode: the rows of runs with new lines, for the lines so far, in whatever order they came). The state
    of a run is some values and the names of its workflows.
    """
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("line_no"))
    item = F.col("done").isNotNull() & F.col("start").isNull() & F.col("end").isNull() & F.col("names").isNull()
    part = F.when(F.col("of") > 0, F.least(F.try_divide("done", "of"), F.lit(1.0))).otherwise(0.0)
    last = _parsed(lines).groupBy("run_id").agg(
        F.max_by("names", at("names")).alias("names"), F.max_by("start", at("start")).alias("start"), F.max(at("start")).alias("start_at"), F.max(at("end")).alias("end_at"), F.collect_set("end").alias("ended"),
        F.max_by(part, F.when(item, F.col("line_no"))).alias("share"), F.max(F.when(item, F.col("line_no"))).alias("item_at"),
    )
    last = last.withColumn("current", F.when(F.col("start_at") > F.coalesce("end_at", F.lit(-1)), F.col("start")))
    names = F.filter(F.transform(F.split("names", ","), lambda x: F.trim(x)), lambda x: x != "")
    out = last.withColumn("w", F.coalesce(names, F.array().cast("array<string>")))
    share = F.when(F.col("current").isNotNull() & (F.col("item_at") > F.col("start_at")), F.col("share")).otherwise(0.0)
    total, done = F.size("w"), F.size(F.array_intersect(F.array_distinct("w"), "ended"))
    fraction = F.when(total > 0, F.least(F.try_divide(done + F.coalesce(share, F.lit(0.0)), total), F.lit(1.0))).otherwise(0.0)
    return out.select("run_id", F.when(total > 0, done).otherwise(0).alias("completed"), total.alias("total"), "current", fraction.alias("fraction"))


def read_log_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """The append-only query log as a stream."""
    return spark.readStream.schema(LOG_SCHEMA).options(**options).json(path)


def stream_cost(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """L2: queries, completed ones and mean duration by method and window; ``late`` must exceed the longest query."""
    rows = log.withWatermark("started_at", late)
    return rows.groupBy(F.window("started_at", window), "method").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.avg("duration_seconds").alias("average_seconds"))


def stream_replace_documents(stream: DataFrame, store: DocumentStore, checkpoint: str, source: str = "stream"):
    """L3: each micro-batch of re-processed rows replaces its documents in the store.

    A batch that comes again after a failure changes nothing. Where a document's rows may be spread over
    batches, the store needs a ``stamp``.
    """
    return stream.writeStream.foreachBatch(lambda batch, n: store.replace(batch, source, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedupe(log: DataFrame, late: str = "1 day") -> DataFrame:
    """L4: one row a query id; ids that come again later than ``late`` count anew."""
    return log.withWatermark("started_at", late).dropDuplicatesWithinWatermark(["query_id"])


def batch_dedupe(log: DataFrame) -> DataFrame:
    """L4 over a table: the earliest row of each query id."""
    return log.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("started_at"))).filter("_n = 1").drop("_n")
