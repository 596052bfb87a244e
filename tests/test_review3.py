"""Queries on rows where they differed from their SQL or did too much."""

import pytest
from pyspark.sql import functions as F

from compare import connection, differences
from docloom.plans import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


def test_customers_of_six_digits_share_no_number(spark, con, tmp_path):
    rows = [(2, 99_999), (1, 199_999), (51, 199_999), (3, None), (53, None), (-3, 7), (47, 7), (50, 7), (100, 8)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = con.cursor()
    con.execute(f"CREATE TEMP VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert differences(QUERIES["e1_validate_question_set"](spark, str(tmp_path)), con, ORACLE_SQL["e1_validate_question_set"]) is None


def test_hubs_give_all_their_links(spark, con):
    rows = QUERIES["g8_hub_neighbours"](spark, SMALL)
    assert dict(rows.dtypes)["rank"] == "int" and rows.filter("rank > 60").count()
    links = con.execute("SELECT max(n) FROM (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1)").fetchone()[0]
    assert rows.groupBy("position").count().agg({"count": "max"}).first()[0] == links


def test_items_count_without_their_first_word(spark, con, tmp_path):
    spark.createDataFrame([(1, "Set the engine torque wrench bolts. No."), (2, "engine torque."), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", "alpha engine torque wrench set"), ("b", "engine torque")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = con.cursor()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE TEMP VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rows = QUERIES["d4_used_groups"](spark, str(tmp_path))
    assert [tuple(r) for r in rows.collect()] == [(1, "a")]
    assert differences(rows, con, ORACLE_SQL["d4_used_groups"]) is None


def test_a_text_that_many_queries_retrieve_is_cut_once(spark, monkeypatch):
    """Sources are compared by texts, not by rows: 40 queries for the same three pages are three texts."""
    from docloom.operators import variants

    kept, own = {}, variants.written
    monkeypatch.setattr(variants, "written", lambda df, name: kept.setdefault(name, own(df, name)))
    body = " ".join(f"w{i}" for i in range(40))
    rows = [(q, p, f"m-{p}", "m", p, tag, text, "") for q in range(40) for p, tag, text in ((1, "A", body), (2, "B", body + " x"), (3, "B", "one two three four"))]
    sources = spark.createDataFrame(rows, "query_id int, ordinal int, key string, document_id string, page int, variant string, text string, compare_text string")
    catalog = spark.createDataFrame([("m", 1, "A"), ("m", 2, "B"), ("m", 3, "B")], "document_id string, page int, variant string")
    questions = spark.createDataFrame([(q, "?") for q in range(40)], "query_id int, question string")
    found = variants.select_sources(sources, questions, catalog).filter("reason is not null").select("key", "reason").collect()
    assert [tuple(r) for r in found] == [("m-2", "same passage as m p.1 [A]")] * 40
    assert kept["texts"].count() == 3


def test_stored_prefixes_meet_only_with_enough_left(spark):
    """A triple that both have, but late in one of them, makes no pair of sets to compare."""
    from docloom.operators import passage_store

    a, late, near = [*range(1, 11)], [50, 51, 52, 53, 1, *range(60, 65)], [*range(1, 10), 70]
    sets = spark.createDataFrame([(1, 10, a), (2, 10, late), (3, 10, near)], "set long, n int, grams array<long>").withColumn("prefix", F.slice("grams", 1, 5))
    assert [tuple(r) for r in passage_store._met(sets, sets).collect()] == [(1, 3)]


def test_words_of_a_sentence_are_found_once(spark):
    from docloom.operators import passages

    answers = spark.createDataFrame([(1, "Set the engine torque wrench bolts. No.")], "question_id int, answer string")
    groups = spark.createDataFrame([("a", "alpha engine torque wrench set")], "group string, text string")
    found = passages.used_groups(answers, groups)
    assert str(found._jdf.queryExecution().optimizedPlan()).count("regexp_extract_all") == 1


def test_citations_are_stripped_as_by_the_patterns_alone(spark):
    from docloom.functions import text as t

    rows = ["a [E1] b", " [E2]", "x [Data: 3 ]\n", " x ", "x\u0085", "\n", " ", "", "[", "a", "a b", " a", "a\r\n", "[來源未映射]a ", "é [e12]", None, "ab​", "a[ E3]", "　[E4]　z"]
    df = spark.createDataFrame([(x,) for x in rows], "x string")
    plain = t.strip(F.regexp_replace(F.coalesce(F.col("x"), F.lit("")), t.CITATION, ""))
    assert df.filter(~t.strip_citations(F.col("x")).eqNullSafe(plain)).count() == 0
