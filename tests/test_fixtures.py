"""Known results on literal rows."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.operators import costs, evidence, metrics, ordering, prepare, sampling, variants


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("pred", "truth", "want"), [("the red red car", "red car", 0.8), ("xyz", "123", 0.0), ("", "the", 1.0), ("", "answer", 0.0)])
def test_char_f1(spark, pred, truth, want):
    assert one(spark, t.char_f1(F.lit(pred), F.lit(truth))) == pytest.approx(want)


def test_cited_ids(spark):
    text = F.lit("A [Data: Sources (12, 34, +more); Entities (5)] b [Data: Reports (1); Sources (56)] c [E3]")
    assert set(one(spark, t.cited_record_ids(text))) == {"12", "34", "56"}
    assert one(spark, t.cited_evidence_ids(text)) == ["E3"]
    assert one(spark, t.strip_citations(text)) == "A b c"


@pytest.mark.parametrize(("text", "want"), [("Title\n12\nBody", "Title\n\nBody"), ("12\nTitle\nBody", "12\nTitle\nBody"), ("1\n2\n3", "1\n2\n3"), ("", "")])
def test_folio(spark, text, want):
    assert one(spark, t.strip_leading_folio(F.lit(text))) == want


@pytest.mark.parametrize(("line", "want"), [("1. Setup", False), ("1、設定 功能", False), ("第 3 章 安裝", True), ("Galaxy AI", True), ("Smart View", False), ("如何使用", True), ("• item", False), ("設定：", False), ("", False)])
def test_headings(spark, line, want):
    assert one(spark, t.is_section_heading(F.lit(line))) is want


@pytest.mark.parametrize(("raw", "want"), [("true", 2.0), ("部分對", 1.0), ("2 x", 2.0), ("83.3%", 1.666), ("1.5", 1.5), ("2.5", None), ("x", None), (None, None), ("NaN", None)])
def test_grades(spark, raw, want):
    got = one(spark, t.parse_grade(F.lit(raw).cast("string")))
    assert got == want


def test_combined_score_never_lowers(spark):
    c = lambda j, s, share: one(spark, t.combined_score(F.lit(j).cast("double"), F.lit(s).cast("double"), F.lit(share)))
    assert (c(0.6, 1.0, 1.0), c(0.6, None, 1.0), c(None, 1.0, 1.0), c(0.98, 1.0, 1.0)) == (0.7, 0.6, None, 1.0)


def test_corpus_metrics(spark):
    p = spark.createDataFrame([("a", "Red car"), ("b", "blue bus stop")], "id string, predicted_answer string")
    g = spark.createDataFrame([("a", "x", ["the red car"]), ("b", "blue bus", None)], "id string, answer string, answer_aliases array<string>")
    r = metrics.corpus_metrics(p, g).first()
    assert (r["n"], r["answer_em"], r["answer_term_hit"], r["answer_term_coverage"]) == (2, 0.5, 1.0, 1.0)
    assert metrics.pairing_errors(p, g.filter("id = 'a'")).collect()[0]["kind"] == "unpaired"


def test_page_fallback(spark):
    e = spark.createDataFrame([("q", 1, "E1", "170", "d", 171, "text_unit", "")], "question_id string, rank int, evidence_id string, context_id string, document_id string, page int, source_type string, added_by string").withColumn("pages", F.lit(None).cast("array<int>"))
    a = spark.createDataFrame([("q", "x [Data: Sources (171)]")], "question_id string, answer string")
    assert metrics.cited_evidence(a, e).count() == 1
    gold = spark.createDataFrame([("q", "d", [172, 180])], "question_id string, document_id string, pages array<int>")
    assert metrics.source_score(a, e, gold).first()["source_score"] == 0.5


def test_variants(spark):
    h = spark.createDataFrame([("d", 1, "[A WITH B]\n< X >"), ("d", 2, "< X >"), ("d", 3, "< Y >"), ("d", 4, "")], "document_id string, page int, text string")
    assert [r["variant"] for r in variants.assign_variants(variants.header_tags(h)).orderBy("page").collect()] == ["A WITH B", "A WITH B", "", ""]


def test_sections_and_continuation(spark):
    pages = spark.createDataFrame([("d.pdf", 1, "如何使用\nbody one\n• step"), ("d.pdf", 2, "goes on\n更改 設定\nlast")], "document_id string, page int, text string")
    s = prepare.split_sections(pages).orderBy("page", "block").collect()
    assert [(r["page"], r["block"], r["heading"]) for r in s] == [(1, 1, "如何使用"), (2, 1, "如何使用"), (2, 2, "更改 設定")]
    chunks = prepare.build_chunk_records(prepare.split_sections(pages))
    got = sorted((r["page"], list(r["pages"])) for r in prepare.merge_continuation(chunks).collect())
    assert got == [(1, [1, 2]), (2, [2])]


def test_cost(spark):
    a = "array<struct<method:string,status:string>>"
    log = spark.createDataFrame([(1, "auto", [("basic", "found")], None, ["c"], 1, 10, 5), (2, "auto", [("basic", "not_found"), ("local", "found")], None, None, None, None, None)], f"query_id int, requested_method string, attempts {a}, search_step_count int, llm_calls array<string>, model_call_count int, prompt_tokens int, completion_tokens int")
    r = costs.aggregate_cost(costs.query_cost(log)).first()
    assert (r["average_search_count"], r["first_choice_hit_rate"], r["measured_query_count"], r["average_total_tokens"]) == (1.5, 0.5, 1, 15.0)


def test_sample_needs_enough_rows(spark):
    c = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    assert sampling.sample_sources(c, 2, 1).count() == 2
    with pytest.raises(ValueError):
        sampling.sample_sources(c, 3, 1)


def test_normalised_questions(spark):
    assert one(spark, sampling.normalize_question(F.lit("ＡＢ c, Straße?"))) == "abcstrasse"


def test_sources_of_any_depth_in_the_order_of_arrival(spark):
    deep = '{"sources": [{"id": "deep"}]}'
    for _ in range(40):
        deep = '{"x": [' + deep + "]}"
    rows = [("a", '{"zeta": {"sources": [{"id": "1"}, 5]}, "alpha": [{"sources": [{"id": "2"}]}], "sources": [{"id": "0"}]}'), ("b", deep), ("c", None), ("d", "{broken")]
    got = evidence.flatten_context_sources(spark.createDataFrame(rows, "query_id string, context string")).collect()
    assert sorted((r["query_id"], r["ordinal"], r["id"]) for r in got) == [("a", 1, "0"), ("a", 2, "1"), ("a", 3, "2"), ("b", 1, "deep")]


def test_a_document_that_is_not_asked_claims_no_question(spark):
    rows = [(1, "A", 1, "q1"), (2, "A", 1, "same"), (3, "B", 1, "same"), (1, "C", 1, "Q1!"), (2, "C", 1, "other")]
    got = sampling.dedupe_questions(spark.createDataFrame(rows, "round int, document_id string, position int, question string"), 1).collect()
    assert sorted((r["document_id"], r["question"]) for r in got) == [("A", "q1"), ("B", "same"), ("C", "other")]


def test_numbers_over_all_ranges(spark):
    got = ordering.numbered(spark.range(1000).repartition(7), ["id"], "n").collect()
    assert sorted((r["id"], r["n"]) for r in got) == [(i, i + 1) for i in range(1000)]


def test_trigrams_and_folios_of_long_texts(spark):
    text, lines = " ".join(f"w{i % 7000}" for i in range(20_000)), "\n".join(["Title", "12", *(f"line {i}" for i in range(20_000))])
    r = spark.createDataFrame([(text, lines)], "a string, b string").select(F.size(t.trigrams(F.col("a"))).alias("n"), t.strip_leading_folio(F.col("b")).alias("s")).first()
    assert r["n"] == 7000 and r["s"] == lines.replace("\n12\n", "\n\n", 1)
