"""Alias expansion by both of its ways, and exact vector search in blocks, against plain versions."""

import random

import numpy as np
import pytest

from docloom.operators import retrieval


def plain_expand(question, aliases):
    if question is None:
        return None
    terms = []
    for _, key, _, term in sorted(a for a in aliases if a[1] is not None and a[3] is not None):
        if key in question and term not in question and term not in terms:
            terms.append(term)
    return question + "\nRelated manual terms: " + "; ".join(terms) if terms else question


@pytest.mark.parametrize("send", [4 << 20, 0])
def test_expand_query(spark, send):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc指紋") for _ in range(n))
    aliases = [(i // 3, None, i % 3, word(rng.randint(1, 4))) for i in range(300)]
    keys = {i: word(rng.choice([1, 2, 2, 3, 4, 5, 6])) for i in range(100)}
    aliases = [(o, keys[o], p, t) for o, _, p, t in aliases] + [(200, "", 0, "always"), (201, None, 0, "x"), (202, "ab", 0, None), (7, keys[7], 0, "twice"), (7, keys[7], 0, "twice")]
    asked = [(i, word(rng.randint(0, 30))) for i in range(120)] + [(900, None), (901, ""), (901, ""), (902, "a" * 20_000)]
    got = retrieval.expand_query(spark.createDataFrame(asked, "question_id long, question string"), spark.createDataFrame(aliases, "ordinal int, key string, position int, term string"), send)
    if send:
        assert sorted(map(str, got.select("question_id", "expanded").collect())) == sorted(str(spark.createDataFrame([(q, plain_expand(x, aliases))], "question_id long, expanded string").first()) for q, x in asked)
    else:  # questions are told apart by their ids there
        assert {r["question_id"]: r["expanded"] for r in got.collect()} == {q: plain_expand(x, aliases) for q, x in asked}
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_large_dictionary_meets_only_by_equal_grams(spark):
    from pyspark.sql import functions as F

    aliases = spark.range(1_000_000).select(F.col("id").alias("ordinal"), F.concat(F.lit("key"), F.col("id"), F.lit("!")).alias("key"), F.lit(0).alias("position"), F.concat(F.lit("term "), F.col("id")).alias("term"))
    asked = spark.range(300).select(F.col("id").alias("question_id"), F.concat(F.lit("what of key"), F.col("id") * 3001, F.lit("! and key5!?")).alias("question"))
    got = {r["question_id"]: r["expanded"].partition("terms: ")[2] for r in retrieval.expand_query(asked, aliases).collect()}
    assert got == {i: "; ".join(f"term {k}" for k in sorted({5, i * 3001} & {*range(1_000_000)})) for i in range(300)}


@pytest.mark.parametrize("send", [64 << 20, 0])
def test_vector_topk(spark, monkeypatch, send):
    monkeypatch.setattr(retrieval, "SEND_BYTES", send)
    rng = np.random.default_rng(2)
    rows = [(f"v{i:03}", x) for i, x in enumerate(rng.normal(size=(150, 6)).tolist())]
    rows += [(f"c{i:03}", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(60)] + [("zero", [0.0] * 6), ("none", None), ("empty", []), ("hole", [1.0, None, 1.0, 1.0, 1.0, 1.0]), ("nan", [float("nan")] * 6), ("short", [1.0, 2.0]), ("v000", rows[0][1])]
    asked = [(i, x) for i, x in enumerate(rng.normal(size=(20, 6)).tolist())] + [(99, [2.0, 4.0, 6.0, 8.0, 10.0, 12.0]), (98, [0.0] * 6), (97, [1.0, 2.0])]
    got = retrieval.vector_topk(spark.createDataFrame(asked, "query_id long, x array<double>"), spark.createDataFrame(rows, "id string, x array<double>").repartition(3), 7, (8, 32)).collect()
    ok = lambda x, n: x is not None and len(x) == n and None not in x and np.isfinite(x).all() and any(x)
    want = []
    for q, x in asked:
        if any(x):
            u = np.array(x) / np.linalg.norm(x)
            scores = sorted((-round(float(u @ (np.array(y) / np.linalg.norm(y))), 9), i) for i, y in rows if ok(y, len(x)))
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:7])]
    assert sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in got) == sorted(want)
