"""Passage groups that follow their documents: equal to groups made anew after documents come, change and go."""

import random

from pyspark.sql import functions as F

from docloom.operators import passages
from docloom.operators.passage_store import PassageGroups, passage_groups_cached

BLOCKS = "document_id string, page int, ordinal int, text string"


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n)]


def edited(text, seed, n):
    rng, w = random.Random(seed), text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"x{seed}{i}"
    return " ".join(w)


def state(seed, documents):
    """Blocks of some documents: shared passages, edited and shortened copies, and own text."""
    rng = random.Random(seed)
    shared = [" ".join(words(k, 40)) for k in range(12)]
    rows = []
    for d in documents:
        own = random.Random(f"{seed}{d}")
        for page in range(4):
            for ordinal in range(3):
                base = shared[own.randrange(12)]
                kind = own.randrange(5)
                text = base if kind == 0 else edited(base, own.randrange(9), 1) if kind == 1 else " ".join(base.split()[: own.randint(26, 39)]) if kind == 2 else " ".join(words(f"{d}{page}{ordinal}{rng.random()}", 30))
                rows.append((d, page, ordinal, text))
    return rows


def rows_of(groups):
    return sorted((r["n_pages"], tuple(r["first"]), r["text"]) for r in groups.collect())


def pages_of(places):
    return sorted({tuple(r) for r in places.select("group", "document_id", "page").collect()})


def test_equal_to_a_rebuild(spark, tmp_path):
    names = [f"d{i}" for i in range(12)]
    now = {n: (state(1, [n]), "1") for n in names}
    table = lambda: spark.createDataFrame([r for rows, _ in now.values() for r in rows], BLOCKS)
    stamps = lambda: spark.createDataFrame([(n, s) for n, (_, s) in now.items()], "document_id string, stamp string")
    store = PassageGroups.build(table(), stamps(), f"{tmp_path}/g", buckets=4)
    changes = [{"d3": None, "d0": state(2, ["d0"]), "d1": state(3, ["d1"]), "new": state(4, ["new"])}, {"d4": None, "d5": [], "d6": state(5, ["d6"]), "d3": state(1, ["d3"])}]
    for k, change in enumerate(changes):
        for name, rows in change.items():
            if rows is None:
                now.pop(name)
            else:
                now[name] = (rows, f"s{k}")
        store.refresh(table(), stamps())
        members = passages.group_members(table())
        assert rows_of(store.groups()) == rows_of(passages.groups_of(members)), k
        assert pages_of(store.places()) == pages_of(members), k
    assert len(rows_of(store.groups())) > 3


def test_a_link_that_goes_splits_its_group(spark, tmp_path):
    a = " ".join(words(1, 40))
    first, last = " ".join(a.split()[:26]), " ".join([*a.split()[14:], *words(5, 2)])
    one = [("a", 1, 1, first), ("b", 1, 1, a), ("c", 1, 1, last), ("d", 1, 1, " ".join(words(9, 40))), ("e", 1, 1, " ".join(words(9, 40)))]
    make = lambda rows: spark.createDataFrame(rows, BLOCKS)
    stamps = lambda rows: make(rows).select("document_id", F.lit("1").alias("stamp")).distinct()
    root = f"{tmp_path}/g"
    got = passage_groups_cached(make(one), stamps(one), root)
    assert sorted(r["n_pages"] for r in got.collect()) == [2, 3]
    left = [r for r in one if r[0] != "b"]
    got = passage_groups_cached(make(left), stamps(left), root)
    assert rows_of(got) == rows_of(passages.group_passages(make(left))) and [r["n_pages"] for r in got.collect()] == [2]


def test_blocks_of_unchanged_documents_are_not_looked_at(spark, tmp_path):
    rows = state(7, ["a", "b"])
    stamps = spark.createDataFrame([("a", "1"), ("b", "1")], "document_id string, stamp string")
    root = f"{tmp_path}/g"
    want = rows_of(passage_groups_cached(spark.createDataFrame(rows, BLOCKS), stamps, root))
    other = spark.createDataFrame(rows, BLOCKS).withColumn("text", F.when(F.col("document_id") == "a", F.lit("another text")).otherwise(F.col("text")))
    assert rows_of(passage_groups_cached(other, stamps, root)) == want
    moved = stamps.withColumn("stamp", F.when(F.col("document_id") == "b", "2").otherwise("1"))
    assert rows_of(passage_groups_cached(other, moved, root)) == want


def test_empty_and_repeated_rows(spark, tmp_path):
    none = spark.createDataFrame([], BLOCKS)
    stamps = spark.createDataFrame([("a", "1")], "document_id string, stamp string")
    root = f"{tmp_path}/g"
    assert passage_groups_cached(none, stamps.limit(0), root).collect() == []
    rows = [("a", 1, 1, " ".join(words(3, 40)))] * 3 + [("a", 2, 1, " ".join(words(3, 40))), ("a", 2, 2, None), ("a", 2, 3, "")]
    got = passage_groups_cached(spark.createDataFrame(rows, BLOCKS), stamps, root)
    assert [(r["n_pages"], tuple(r["first"])) for r in got.collect()] == [(2, ("a", 1))]
