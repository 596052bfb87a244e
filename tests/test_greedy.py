"""Greedy exclusion by rounds against the fold it stands for, and source selection on literal rows."""

import random

from docloom.operators import greedy, variants


def fold(edges):
    by = {}
    for later in sorted({b for _, b in edges}):
        first = [a for a, b in sorted(edges) if b == later and a not in by]
        if first:
            by[later] = first[0]
    return by


def test_random_edges(spark):
    rng = random.Random(3)
    for n, m in ((12, 20), (40, 60), (200, 400)):
        edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        got = greedy.excluded(spark.createDataFrame(sorted(edges) * 2, "first int, later int")).collect()
        assert {r["row"]: r["by"] for r in got} == fold(edges)


def test_chains_and_no_edges(spark):
    chain = [(i, i + 1) for i in range(9)]
    got = greedy.excluded(spark.createDataFrame(chain, "first int, later int")).collect()
    assert {r["row"]: r["by"] for r in got} == {i: i - 1 for i in (1, 3, 5, 7, 9)}
    assert greedy.excluded(spark.createDataFrame([], "first int, later int")).collect() == []


def test_sources_of_one_text_in_several_variants(spark):
    """The reference's cases: a dropped source drops nothing, sources of one variant never drop each other, documents stand apart."""
    text = " ".join(f"word{i} of the same passage" for i in range(40))
    near = text.replace("word3 ", "other ")
    pages = [("m", 1, "A", text), ("m", 2, "A", text), ("m", 3, "B", near), ("m", 4, "B", "short"), ("m", 5, "C", text), ("m", None, "C", text), ("n", 1, "", text), ("k", 1, "A", text), ("k", 2, "A", text)]
    rows = [("q", i, f"u{i}", d, p, variant, x, "") for i, (d, p, variant, x) in enumerate(pages)] + [("r", 0, "v", "m", 5, "C", text, None)]
    sources = spark.createDataFrame(rows, "query_id string, ordinal int, key string, document_id string, page int, variant string, text string, compare_text string")
    catalog = spark.createDataFrame([("m", 1, "A"), ("m", 3, "B"), ("m", 5, "C"), ("k", 1, "A")], "document_id string, page int, variant string")
    asked = spark.createDataFrame([("q", "which one?"), ("r", None)], "query_id string, question string")
    got = {(r["query_id"], r["key"]): r["reason"] for r in variants.select_sources(sources, asked, catalog).collect()}
    why = "same passage as m p.1 [A]"
    assert got == {("q", "u0"): None, ("q", "u1"): None, ("q", "u2"): why, ("q", "u3"): None, ("q", "u4"): why, ("q", "u5"): why, ("q", "u6"): None, ("q", "u7"): None, ("q", "u8"): None, ("r", "v"): None}


def test_a_query_with_many_sources(spark):
    """Thousands of sources of one query and document, of which many have one text."""
    texts = [" ".join(f"t{k} w{i}" for i in range(12)) for k in range(40)]
    rows = [("q", i, f"u{i}", "m", i, "ABC"[i % 3], texts[(i * 7) % 40], "") for i in range(6000)]
    sources = spark.createDataFrame(rows, "query_id string, ordinal int, key string, document_id string, page int, variant string, text string, compare_text string")
    catalog = spark.createDataFrame([("m", 1, "A"), ("m", 3, "B"), ("m", 5, "C")], "document_id string, page int, variant string")
    asked = spark.createDataFrame([("q", "")], "query_id string, question string")
    got = {r["key"]: r["reason"] for r in variants.select_sources(sources, asked, catalog).collect()}
    first = {}
    for _, i, key, _, page, variant, text, _ in rows:
        by = first.setdefault(text, (page, variant))
        assert got[key] == (None if by[1] == variant else f"same passage as m p.{by[0]} [{by[1]}]")
