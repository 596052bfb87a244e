"""A hub's relationships lie in several parts, and none of the heaviest is lost between them."""

import random

from docloom.operators import metrics, retrieval


def test_hub_is_dealt_to_parts(spark):
    rng = random.Random(3)
    edges = [("hub", f"p{i}", rng.randint(1, 40)) for i in range(900)] + [(f"s{i % 30}", f"p{i}", i % 7) for i in range(300)]
    rel = spark.createDataFrame(edges, "source string, target string, weight long")
    top = spark.createDataFrame([(1, 1, "hub"), (1, 2, "s3"), (2, 1, "s4")], "query_id int, rank int, entity_id string")
    units = spark.createDataFrame([("hub", "u1")], "entity_id string, unit_id string")
    found = retrieval.local_expand(top, rel, units, 5)[0]
    got = sorted((r.query_id, r["rank"], r.source, r.target, r.weight) for r in found.collect())
    want = []
    for q, names in ((1, {"hub", "s3"}), (2, {"s4"})):
        best = sorted((e for e in edges if e[0] in names), key=lambda e: (-e[2], e[0], e[1]))[:5]
        want += [(q, i + 1, *e) for i, e in enumerate(best)]
    assert got == want
    assert "_part" in found._jdf.queryExecution().optimizedPlan().toString()


def test_cited_evidence_is_worked_out_once(spark):
    answers = spark.createDataFrame([(1, "x [Data: Sources (7)] [E2]"), (2, "none")], "question_id int, answer string")
    cells = "question_id int, rank int, evidence_id string, context_id string, document_id string, page int, pages array<int>, source_type string, added_by string"
    evidence = spark.createDataFrame([(1, 1, "E1", "5", "d", 7, None, "text_unit", ""), (1, 2, "E2", "6", "e", 3, None, "text_unit", "")], cells)
    gold = spark.createDataFrame([(1, "d", [8]), (1, "f", [1]), (2, "d", [1])], "question_id int, document_id string, pages array<int>")
    found = metrics.source_score(answers, evidence, gold)
    assert {(r.question_id, r.source_score) for r in found.collect()} == {(1, 0.5), (2, None)}
    # the cited pages are read from a written table
    assert not any("cited_record" in x or "Sources" in x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines())
