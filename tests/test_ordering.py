"""Values along an order that passes over ranges, ranks and percentiles, against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import experiments, ordering, prepare, variants


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables stay in several ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def rows():
    rng = random.Random(5)
    out = [("hot", p, rng.choice([None, None, "a", "b"])) for p in range(3000)]
    out += [(f"d{rng.randrange(40)}", 10_000 + p, rng.choice([None, "x", "y"])) for p in range(400)] + [(None, 1, "n"), (None, 2, None), ("one", 5, None)]
    rng.shuffle(out)
    return out


def test_neighbours_carried_and_numbers(spark, rows):
    df = spark.createDataFrame(rows, "document_id string, page int, value string")
    placed = ordering.placed(df.repartition(6), ["document_id"], ["page"])
    assert placed.filter("document_id = 'hot'").select("_range").distinct().count() > 1
    met = ordering.with_neighbours(placed, ["document_id"], ["page"], ["page", "value"])
    met = ordering.carried(met, ["document_id"], ["page"], "value", "before")
    met = ordering.carried(met, ["document_id"], ["page"], "value", "upto", own=True)
    got = {(r["document_id"], r["page"]): (r["_before"] and tuple(r["_before"]), r["_after"] and tuple(r["_after"]), r["before"], r["upto"]) for r in met.collect()}
    numbers = {(r["document_id"], r["page"]): (r["n"], r["size"]) for r in ordering.numbered_within(df, ["document_id"], ["page"], "n", "size").collect()}
    for name in {r[0] for r in rows}:
        own = sorted(((r[1], r[2]) for r in rows if r[0] == name), key=lambda x: x[0])
        last = None
        for k, (page, value) in enumerate(own):
            upto = value if value is not None else last
            assert got[name, page] == (own[k - 1] if k else None, own[k + 1] if k + 1 < len(own) else None, last, upto)
            assert numbers[name, page] == (k + 1, len(own))
            last = upto


def test_one_document_of_many_pages(spark):
    """Headings, variants and continued pages of one document pass over all ranges."""
    n = 20_000
    pages = spark.range(n).select(F.lit("m").alias("document_id"), F.col("id").cast("int").alias("page"), F.when(F.col("id") % 1500 == 0, F.concat(F.lit("如何使用 "), F.col("id"), F.lit("\nbody"))).otherwise("text").alias("text"))
    got = {r["page"]: (r["block"], r["heading"]) for r in prepare.split_sections(pages).collect()}
    assert got == {p: (1, f"如何使用 {p - p % 1500}") for p in range(n)}
    headers = pages.select("document_id", "page", F.when(F.col("page") % 5000 == 7, "[A B]\n< X >").otherwise("< X >").alias("text"))
    tags = {r["page"]: r["variant"] for r in variants.assign_variants(variants.header_tags(headers)).collect()}
    assert tags == {p: "A B" if p >= 7 else "" for p in range(n)}
    chunks = prepare.build_chunk_records(prepare.split_sections(pages))
    merged = {r["page"]: list(r["pages"]) for r in prepare.merge_continuation(chunks).collect()}
    assert merged == {p: [p, p + 1] if p % 1500 == 0 else [p] for p in range(n) if p % 1500 != 1}


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_nearest_rank(spark, share):
    rng = random.Random(7)
    values = {"wide": [rng.lognormvariate(0, 4) * rng.choice([-1, 1]) for _ in range(900)], "one": [3.5], "same": [2.0] * 500, "two": [1.0] * 300 + [1e300] * 20, "far": [-1e308, 1e308, 0.0, 5e-324, 1.0] * 40, None: [float(i) for i in range(250)]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("wide", None), ("wide", float("nan")), ("one", float("inf")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["p"] for r in ordering.nearest_rank(df, ["g"], "v", share, "p", few=20, buckets=8).collect()}
    assert got == {k: sorted(vs)[max(0, math.ceil(share * len(vs)) - 1)] for k, vs in values.items()}


def test_percentile_of_many_distinct_values(spark):
    df = spark.range(1_000_000).select((F.col("id") % 2).alias("group_id"), F.pmod(F.col("id") * 7_919, F.lit(1_000_003)).cast("double").alias("duration_seconds"))
    got = {r["group_id"]: r["p95_latency_seconds"] for r in experiments.p95_latency(df, "group_id").collect()}
    want = {r["group_id"]: r["p"] for r in df.groupBy("group_id").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_seconds)").alias("p")).collect()}
    assert got == want
