"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (tests), an own one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
        return f"file://{found}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder that outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of writes in here go as soon as the rows are written."""
    was = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, was)


def written(df: DataFrame, name: str) -> DataFrame:
    """Like kept(), as Parquet: for rows with wide columns, of which later reads prune some."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Like written(), with little disk: Zstandard, and no shuffle files are left."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def workspace(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """keep(df, name) is packed() in a folder that goes at the end: what outlives it has to be written before."""
    root = scratch(spark, name)
    try:
        yield lambda df, table: packed(df, table, f"{root}/{table}-{uuid.uuid4().hex}")
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a costly column that later filters and projections don't work out again."""
    return df.select("*", F.explode(F.array(value)).alias(name))
