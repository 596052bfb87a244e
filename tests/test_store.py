"""The document store: batches in any number and order, replays, failures, and streams over several files."""

import pytest
from pyspark.sql import functions as F

from docloom.sources.store import DocumentStore
from docloom.sources.tables import replace_documents
from docloom.streaming import logs

SCHEMA = "document_id string, page int, text string, run int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def old(spark):
    return spark.createDataFrame([(f"d{i % 20}", i, f"old {i}", 1) for i in range(200)] + [(None, 1, "no name", 1)], SCHEMA)


@pytest.fixture
def new(spark):
    return spark.createDataFrame([(f"d{i % 7}", i, f"new {i}", 2) for i in range(90)] + [("fresh", 1, None, 2), (None, 5, "renamed", 2)], SCHEMA)


def test_one_change_is_the_replaced_table(old, new, tmp_path):
    store = DocumentStore.create(old, f"{tmp_path}/s", buckets=5)
    assert rows_of(store.read()) == rows_of(old)
    assert store.replace(new) == 1
    named = old.filter("document_id is not null"), new.filter("document_id is not null")
    want = rows_of(replace_documents(*named)) + rows_of(new.filter("document_id is null"))
    assert rows_of(store.read()) == sorted(want, key=str)
    assert rows_of(store.read(0)) == rows_of(old)


@pytest.mark.parametrize("files", [1, 2, 3])
def test_batches_of_a_stream(spark, old, new, tmp_path, files):
    want = rows_of(old.join(new.select("document_id").distinct().withColumnRenamed("document_id", "n"), F.col("document_id").eqNullSafe(F.col("n")), "left_anti").unionByName(new))
    new.repartition(files).write.parquet(f"{tmp_path}/new")
    store = DocumentStore.create(old, f"{tmp_path}/s", stamp="run", buckets=5)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/new")
    job = logs.stream_replace_documents(stream, store, f"{tmp_path}/check")
    job.awaitTermination()
    assert rows_of(store.read()) == want
    assert store.versions() == [*range(files + 1)]
    # a batch that comes again, and rows of an older run, change nothing
    assert store.replace(new.limit(3), "stream", files - 1) == files
    store.replace(old.join(new.select("document_id").distinct(), "document_id", "left_semi"))
    assert rows_of(store.read()) == want


def test_the_order_of_batches_does_not_matter(spark, old, new, tmp_path):
    third = spark.createDataFrame([("d1", 0, "third", 3), ("fresh", 9, "third", 3)], SCHEMA)
    results = []
    for k, order in enumerate(((0, 1, 2), (2, 1, 0), (1, 2, 0))):
        store = DocumentStore.create(old, f"{tmp_path}/{k}", stamp="run", buckets=3)
        for b in order:
            store.replace((new.filter("page < 40"), new.filter("page >= 40"), third)[b])
        results.append(rows_of(store.read()))
    assert results[0] == results[1] == results[2]


def test_only_touched_buckets_are_written(spark, old, tmp_path):
    store = DocumentStore.create(old, f"{tmp_path}/s", buckets=8)
    before = store.manifest()["folders"]
    store.replace(spark.createDataFrame([("d3", 1, "x", 2)], SCHEMA))
    after = store.manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1


def test_documents_that_go(spark, old, tmp_path):
    store = DocumentStore.create(old.withColumn("gone", F.lit(False)), f"{tmp_path}/s", stamp="run", gone="gone", buckets=4)
    store.replace(spark.createDataFrame([("d1", None, None, 5, True)], f"{SCHEMA}, gone boolean"))
    assert store.read().filter("document_id = 'd1'").count() == 0
    store.replace(old.filter("document_id = 'd1'").withColumn("gone", F.lit(False)))  # older than its end
    assert store.read().filter("document_id = 'd1'").count() == 0
    store.drop_documents(spark.createDataFrame([("d2",), ("none",)], "document_id string"))
    assert rows_of(store.read().drop("gone")) == rows_of(old.filter("document_id is null or document_id not in ('d1', 'd2')"))


def test_a_failed_change_leaves_the_version(spark, old, tmp_path):
    store = DocumentStore.create(old, f"{tmp_path}/s", buckets=4)
    bad = old.withColumn("text", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        store.replace(bad)
    assert store.versions() == [0] and rows_of(store.read()) == rows_of(old)
    store.replace(old.filter("page < 50"))
    store.replace(old.filter("page < 20"))
    want = rows_of(store.read())
    assert store.vacuum(keep=1) > 0 and store.versions() == [2]
    assert rows_of(store.read()) == want


def test_empty_tables(spark, old, tmp_path):
    store = DocumentStore.create(old.limit(0), f"{tmp_path}/s")
    assert store.read().count() == 0 and store.replace(old.limit(0)) == 0
    store.replace(old)
    assert rows_of(store.read()) == rows_of(old)
