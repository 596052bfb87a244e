"""Readers and writers of page, chunk, index, log and question-set tables.

Readers return rows; rows that can't be used come as a second DataFrame of errors, so that one bad
record does not end a job. Writers rely on Spark's job commit for atomic replacement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_FIELDS = ["chunk_id", "project_id", "section_id", "section_name", "document_id", "page", "block_id", "text"]
CHUNK_SCHEMA = "id string, chunk_id string, project_id string, section_id string, section_name string, section_path string, title string, text string, document_id string, page int, block_id string, sectioning_version int, pages array<int>, _corrupt_record string"
LOG_SCHEMA = "query_id string, project_id string, question string, method string, requested_method string, status string, answer string, error string, started_at timestamp, completed_at timestamp, duration_seconds double, source string, execution_metadata string"
SOURCE = "array<struct<document_name:string,pages:array<int>>>"
QUESTION_SET_SCHEMA = f"questions array<struct<number:int,question:string,expected_answer:string,answer_aliases:array<string>,question_sources:{SOURCE},answer_sources:{SOURCE}>>"


def read_pages(spark: SparkSession, path: str, kind: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Pages in order, and one error row for each document that can't be read."""
    rows = spark.read.schema("document_id string, page int, text string, error string").format(kind).load(path)
    bad = rows.filter(F.col("error").isNotNull() & F.col("page").isNull()).groupBy("document_id").agg(F.min("error").alias("error"))
    pages = rows.filter(F.col("page").isNotNull()).select("document_id", "page", F.coalesce("text", F.lit("")).alias("text"), "error")
    return pages, bad


def read_chunks(spark: SparkSession, path: str, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunk records from JSON lines, and the records that miss required fields (which ones)."""
    rows = spark.read.schema(CHUNK_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return check_chunks(rows, required)


def check_chunks(rows: DataFrame, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    cells = [F.when(F.col(c).isNull(), F.lit(c)) for c in required or CHUNK_FIELDS]
    marked = rows.withColumn("missing", F.array_compact(F.array(*cells)))
    good = marked.filter(F.size("missing") == 0).drop("missing", "_corrupt_record")
    return good, marked.filter(F.size("missing") > 0).select("chunk_id", "missing")


def read_index_table(spark: SparkSession, folder: str, name: str, columns: str, optional: bool = False) -> DataFrame:
    """S3: some columns (DDL) of a Parquet table; an optional table that is absent reads as empty."""
    schema = T._parse_datatype_string(columns)
    path = f"{folder}/{name}.parquet"
    if optional:
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
            return spark.createDataFrame([], schema)
    found = spark.read.parquet(path)
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_query_log(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The query log; a malformed line fails (strict) or is left out."""
    return spark.read.schema(LOG_SCHEMA).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that the tolerant reader leaves out."""
    rows = spark.read.schema(f"{LOG_SCHEMA}, _corrupt_record string").json(path)
    return rows.filter(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")


def read_question_set(spark: SparkSession, path: str) -> DataFrame:
    """One row a question of a JSON object {"questions": [...]}, with its position."""
    return question_rows(spark.read.schema(QUESTION_SET_SCHEMA).option("multiLine", True).json(path))


def question_rows(nested: DataFrame) -> DataFrame:
    return nested.select(F.posexplode("questions").alias("position", "q")).select("position", "q.*")


def read_versioned_results(rows: DataFrame, defaults: dict[str, object], schema: str) -> DataFrame:
    """Rows saved by any version: unknown fields dropped, absent or null ones filled in."""
    have = set(rows.columns)
    cells = []
    for f in T._parse_datatype_string(schema).fields:
        value = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if f.name in defaults:
            value = F.coalesce(value, F.lit(defaults[f.name]).cast(f.dataType))
        cells.append(value.alias(f.name))
    return rows.select(*cells)


def chunk_order(df: DataFrame) -> list[F.Column]:
    return [F.lower("document_id"), F.col("document_id"), F.col("page"), F.col("block_id")]


def write_chunks(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """JSON lines sorted by (document, page, block) over all files, replaced as a whole."""
    order = chunk_order(df)
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").json(path)


def append_query_log(df: DataFrame, path: str) -> None:
    """Append; each task adds its own file, so writers need no lock."""
    df.write.mode("append").json(path)


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def export_json_csv(df: DataFrame, folder: str) -> None:
    """The table as JSON lines and as CSV with a header."""
    df.write.mode("overwrite").json(f"{folder}/json")
    flat_for_csv(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/csv")


def export_question_set(questions: DataFrame) -> DataFrame:
    """Portable rows: numbered from 1 by position, sources with pages only, gold where a list is empty."""
    from pyspark.sql import Window as W

    paged = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast(SOURCE)), lambda s: F.size(s["pages"]) > 0)
    sources = lambda c: F.when(F.size(paged(c)) > 0, paged(c)).otherwise(paged("gold_sources"))
    number = F.row_number().over(W.partitionBy("question_set_id").orderBy("position"))
    return questions.select("question_set_id", number.alias("number"), "question", F.col("reference_answer").alias("expected_answer"), F.coalesce("answer_aliases", F.array().cast("array<string>")).alias("answer_aliases"), sources("question_sources").alias("question_sources"), sources("answer_sources").alias("answer_sources"))


def delete_by_source(log: DataFrame, sources: list[str | None]) -> tuple[DataFrame, DataFrame]:
    """(kept rows, removed rows) by a list of sources that may hold null."""
    hit = F.lit(False)
    for s in sources:
        hit = hit | F.col("source").eqNullSafe(F.lit(s))
    return log.filter(~hit), log.filter(hit)


def replace_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of documents that were processed again are replaced, others stay."""
    return old.join(new.select("document_id").distinct(), "document_id", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def drop_documents(names: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The tables without the rows of the named documents."""
    gone = names.select("document_id").distinct()
    return [t.join(gone, "document_id", "left_anti") for t in tables]
