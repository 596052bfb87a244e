"""Progress of runs as a stream against the table's, in any order of files, and contexts on odd values."""

import random

from docloom.operators import evidence
from docloom.streaming import logs


def test_progress_of_a_stream_is_that_of_the_table(spark, tmp_path):
    rng, rows = random.Random(4), []
    for run in range(12):
        names = [f"w{i}" for i in range(rng.randint(0, 4))]
        lines = ["Starting pipeline with workflows: " + ", ".join(names)] if names else ["hello"]
        for w in names[: rng.randint(0, 4)]:
            lines += [f"Starting workflow: {w}", "3 / 10 done", "x", f" {rng.randint(0, 12)}/10 items", "1/0 odd"]
            if rng.random() < 0.7:
                lines.append(f"Workflow complete: {w}")
        rows += [(run, k, line) for k, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "run_id long, line_no long, line string")
    want = sorted(tuple(r) for r in logs.workflow_progress(df).collect())
    for files in (1, 3):
        df.repartition(files).write.parquet(f"{tmp_path}/{files}")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{files}")
        last = {}

        def keep(part, _, last=last):
            last.update({r["run_id"]: tuple(r) for r in part.collect()})

        logs.workflow_progress(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c{files}").trigger(availableNow=True).start().awaitTermination()
        assert sorted(last.values()) == want


def test_names_that_hold_no_list_are_not_walked(spark):
    """An object under a name of the records is neither a record nor searched."""
    rows = [("a", '{"sources": {"sources": [{"id": "1", "text": "x"}]}}'), ("b", '{"reports": {"sources": [{"id": "2", "text": "x"}]}, "more": {"reports": [{"id": "3", "text": "y"}]}}'), ("c", '{"sources": 5, "x": [[{"sources": [{"id": "4", "text": "z"}]}]]}')]
    df = spark.createDataFrame(rows, "query_id string, context string")
    assert sorted((r["query_id"], r["id"]) for r in evidence.flatten_context_sources(df).collect()) == [("b", "2"), ("c", "4")]
    assert sorted((r["query_id"], r["source_id"], r["source_type"]) for r in evidence.extract_step_evidence(df).collect()) == [("b", "3", "community_report"), ("c", "4", "text_unit")]
