"""Word triples from bytes against the column function, and equal pages as one set."""

from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.operators import passages, similarity, variants

TEXTS = ["One two three FOUR one two three four", "a b", "", None, "導航系統 a1-b2 c3 導航系統 A1 b2 c3", "KK 1 Iİx y z", "é ß x1 y1 z1 é x1 y1 z1", "INFOID: 12 see AB-12 turn the key, turn THE key"] * 3


def test_triples_of_bytes(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").repartition(2)
    words = rows.select("i", t.trigrams(t.comparable(F.col("text"))).alias("want"), t.trigram_hashes(t.without_references(F.col("text"))).alias("got")).collect()
    assert len(words) == len(TEXTS) and sum(len(r.got) for r in words) > 20
    names = {}
    for r in words:
        assert len(r.got) == len(r.want) and r.got == sorted(set(r.got))
    for r in words:  # one hash for one triple, in all texts
        for s in words:
            assert len(set(r.got) & set(s.got)) == len(set(r.want) & set(s.want)), (r, s, names)


def test_equal_pages_are_one_set(spark, monkeypatch):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(f"d{i % 2}", i, text(i % 3) + (" tail" if i % 4 == 3 else "")) for i in range(48)]
    pages = spark.createDataFrame([*rows, ("d0", 90, ""), ("d0", 91, None)], "document_id string, page int, text string")
    seen = []
    join = similarity.similar_sets
    monkeypatch.setattr(similarity, "similar_sets", lambda sets, *a: seen.append(sets.count()) or join(sets, *a))
    got = {tuple(r) for r in passages.page_equivalence(pages).collect()}
    want = {(d, p, q) for d, p, x in rows for e, q, y in rows if d == e and x[:200] == y[:200]} | {("d0", 90, 90), ("d0", 91, 91)}
    assert got == want
    assert seen == [len({(d, x) for d, _, x in rows})]


def test_earliest_pages_of_copies(spark):
    text = " ".join(f"w{j}" for j in range(60))
    catalog = spark.createDataFrame([("d", p, "AB"[p % 2]) for p in range(6)], "document_id string, page int, variant string")
    bodies = spark.createDataFrame([("d", p, text) for p in range(6)], "document_id string, page int, text string")
    sources = spark.createDataFrame([("q", f"k{p}", "d", p, "AB"[p % 2]) for p in range(6)], "query_id string, key string, document_id string, page int, variant string")
    named = spark.createDataFrame([], "question_id string, document_id string, variant string")
    got = {tuple(r) for r in variants.earliest_equivalent_pages(sources, catalog, bodies, named).collect()}
    assert got == {("q", f"k{p}", 1 - p % 2) for p in range(1, 6)}
