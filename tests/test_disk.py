"""Classes of similar sets: the same as from all pairs, with little disk beside their rows."""

import itertools
import random
from pathlib import Path

from pyspark.sql import functions as F

from docloom.operators import passages
from docloom.operators.passage_store import passage_groups_cached
from docloom.operators.similarity import among, classes, shared_enough
from docloom.plans import QUERIES
from docloom.sources.scratch import shared_dir

SMALL = "/root/testdata/sf0.001"

BLOCKS = "document_id string, page int, ordinal int, text string"


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n)]


def bytes_of(folder):
    return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())


def test_passages_leave_no_sets_on_disk(spark):
    rng = random.Random(3)
    rows = [("d", page, 0, " ".join(words(rng, 150))) for page in range(1500)]
    rows += [("e", page, 0, text) for _, page, _, text in rows[:40]]
    before = bytes_of(root := Path(shared_dir(spark).removeprefix("file://")))
    got = passages.group_passages(spark.createDataFrame(rows, BLOCKS)).collect()
    assert len(got) == 40 and {r["n_pages"] for r in got} == {2}
    # eight bytes for each triple of a passage is what one copy of the sets takes
    assert bytes_of(root) - before < 8 * 148 * 1500 / 4


def test_stored_groups_hold_no_sets(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"d{page % 5}", page, 0, " ".join(words(rng, 150))) for page in range(1500)]
    rows += [("e", page, 0, text) for _, page, _, text in rows[:40]]
    before = bytes_of(root := Path(shared_dir(spark).removeprefix("file://")))
    stamps = spark.createDataFrame([(f"d{i}", "1") for i in range(5)] + [("e", "1")], "document_id string, stamp string")
    blocks = spark.createDataFrame(rows, BLOCKS)
    assert passage_groups_cached(blocks, stamps, f"{tmp_path}/g").count() == 40
    got = passage_groups_cached(blocks, stamps.withColumn("stamp", F.when(F.col("document_id") == "d1", "2").otherwise("1")), f"{tmp_path}/g")
    assert [r["n_pages"] for r in got.collect()] == [2] * 40
    assert bytes_of(root) - before + bytes_of(tmp_path) < 8 * 148 * 1500 * 1.5


def test_expansion_leaves_less_than_its_input_on_disk(spark):
    before = bytes_of(root := Path(shared_dir(spark).removeprefix("file://")))
    assert QUERIES["d5_expansion_locations"](spark, SMALL).count() > 0
    assert bytes_of(root) - before < Path(f"{SMALL}/documents.parquet").stat().st_size


def shuffled(spark):
    """Bytes that all stages so far wrote for others."""
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList
    stages = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_only_texts_of_asked_pages_are_shuffled(spark):
    rng = random.Random(2)
    evidence = spark.createDataFrame([("q", 1, "E1", "1", "d", 1, "u", "", "text_unit", "")], "question_id string, rank int, evidence_id string, context_id string, document_id string, page int, text_unit_id string, text string, source_type string, added_by string")
    locations = spark.createDataFrame([("q", "d", 7, 1), ("q", "d", 1, 1)], "question_id string, document_id string, page long, group long")
    groups = spark.createDataFrame([(1, "abc def")], "group long, text string")
    meta = spark.createDataFrame([(f"u{page}", "d", page, "abc " + " ".join(words(rng, 1000))) for page in range(400)], "text_unit_id string, document_id string, page int, text string").repartition(4).checkpoint()
    got = passages.with_duplicate_citations(evidence, locations, groups, meta, meta.select("text_unit_id", F.lit("c").alias("context_id")))
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r["rank"], r["page"], r["text_unit_id"], r["added_by"]) for r in rows) == [(1, 1, "u", "duplicate_passage"), (2, 7, "u7", "duplicate_passage")]
    assert shuffled(spark) - before < 400 * 3000 / 4


def test_only_sets_that_others_hold_enough_of(spark):
    rng = random.Random(5)
    pool = [rng.getrandbits(63) for _ in range(600)]
    sets = [(i, sorted(rng.sample(pool[:60] if i % 3 else pool, rng.randint(1, 40)) + [rng.getrandbits(63) for _ in range(rng.randint(0, 30))]), i % 4 > 0) for i in range(300)]
    sets.append((900, [rng.getrandbits(63) for _ in range(70_000)], True))
    got = {r[0] for r in shared_enough(spark.createDataFrame(sets, "id long, grams array<long>, new boolean"), 80_000, 0.54).collect()}
    held = lambda i, new: {x for j, g, fresh in sets if j != i and (fresh or new) for x in g}
    want = {i for i, g, new in sets if len(held(i, new) & {*g}) >= 0.54 * len(g)}
    assert got == want and 30 < len(want) < 280


def test_filter_of_keys(spark):
    rows = spark.range(200_000).select(F.xxhash64("id").alias("row"), "id")
    keys = rows.filter("id % 7 = 0").select("row")
    got = {r[0] for r in among(rows, "row", keys).select("id").collect()}
    assert got >= {*range(0, 200_000, 7)} and len(got) < 45_000
    assert among(rows, "row", keys.limit(0)).count() == 0


def test_classes_of_repeated_rows(spark):
    """Rows of one place and ordinal but other texts, rows that are the same altogether, and places that are null."""
    rng = random.Random(9)
    base = [rng.sample(range(10**9), 30) for _ in range(12)]
    rows = []
    for i in range(150):
        g = sorted({*rng.choice(base)} ^ {*rng.sample(range(10**9), rng.randint(0, 2))})
        rows += [(i, rng.choice(["a", "b", None]), rng.randrange(5), g)] * rng.randint(1, 2)
    df = spark.createDataFrame(rows, "row long, document_id string, page int, grams array<long>")
    got = classes(df.drop("grams"), lambda of: of.join(df.select("row", "grams").distinct(), "row"), ["document_id", "page"], ["document_id", "page"], 0.9, 0.6).collect()
    assert len(got) == len(rows)
    places, label = {}, {}
    for _, d, p, g in rows:
        places.setdefault(tuple(g), set()).add((d, p))
        label[tuple(g)] = tuple(g)
    for _ in range(20):
        for x, y in itertools.combinations(label, 2):
            if len({*x} & {*y}) >= 0.9 * min(len(x), len(y)) and min(len(x), len(y)) >= 0.6 * max(len(x), len(y)) and len(places[x] | places[y]) > 1:
                label[x] = label[y] = min(label[x], label[y])
    of = {r[0]: label[tuple(r[3])] for r in rows}
    pairs = {(of[r["row"]], r["group"]) for r in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) < 60
