"""Queries of judges, experiments, costs, retrieval and graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.operators import costs, experiments, graph, judges, metrics, retrieval
from docloom.plans import views as v
from docloom.plans.registry import query
from docloom.sources.scratch import table


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- judges ----
@query("SELECT doc_id AS question_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN NULL ELSE quality + 3 END AS level, CASE WHEN doc_id % 4 = 0 THEN 'no JSON object' WHEN doc_id % 4 = 1 THEN 'level' END AS error, CASE WHEN doc_id % 4 > 1 THEN quality = 0 END AS extra_content_error FROM labels")
def j1_parse_verdicts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "labels")
    v_ = F.to_json(F.struct(F.col("doc_id").cast("string").alias("question_id"), F.when(F.col("doc_id") % 4 == 1, 7).otherwise(F.col("quality") + 3).alias("level"), F.lit("fine").alias("reason"), F.lit(True).alias("extra_content_error")))
    text = F.when(F.col("doc_id") % 4 == 0, "I can't {say").otherwise(F.concat(F.lit("Sure {x: "), v_, F.lit(" done")))
    out = judges.parse_verdicts(r.select(F.col("doc_id").cast("string").alias("question_id"), F.lit("m").alias("model"), text.alias("response")))
    return out.select(F.col("question_id").cast("long").alias("question_id"), "level", "error", "extra_content_error")


@query("SELECT l_orderkey, l_linenumber, (l_linenumber % 6) / 5 AS score, (l_linenumber % 6) / 5 >= 0.8 AS correct FROM lineitem")
def j2_rubric_score(spark: SparkSession, d: str) -> DataFrame:
    s = judges.rubric_score(F.col("l_linenumber") % 6)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.alias("score"), judges.is_correct(s).alias("correct"))


SCORES = v.JUDGES + ", scores AS (SELECT question_id, round(avg(score), 4) AS average_score, coalesce(avg(CASE WHEN score IS NOT NULL THEN extra::INT END), 0.0) AS extra_share, count(score) AS judged, coalesce(round(avg(score), 4) >= 0.8, false) AS is_correct, string_agg(model || CASE WHEN score IS NULL THEN ': failed ' || error ELSE ': ' || reason END, chr(10) ORDER BY model) AS reasons FROM judges GROUP BY 1)"


@query("WITH " + SCORES + " SELECT * FROM scores")
def j3_question_scores(spark: SparkSession, d: str) -> DataFrame:
    return judges.question_scores(v.judges(spark, d))


@query("WITH " + v.JUDGES + " SELECT model, round(avg(score), 4) AS average_score, count(score) AS judged, (SELECT count(*) FROM (SELECT question_id FROM judges GROUP BY 1 HAVING count(DISTINCT score) > 1)) AS disagreements FROM judges WHERE score IS NOT NULL GROUP BY 1")
def j4_judge_panel_summary(spark: SparkSession, d: str) -> DataFrame:
    j = v.judges(spark, d)
    return judges.judge_averages(j).crossJoin(judges.judge_disagreements(j))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return judges.question_scores(v.judges(spark, d)).withColumn("source_score", F.when(F.col("question_id") % 3 != 0, (F.col("question_id") % 5) / 5))


COMB = SCORES + ", s AS (SELECT *, CASE WHEN question_id % 3 <> 0 THEN (question_id % 5) / 5 END AS source_score FROM scores)"


@query("WITH " + COMB + ", n AS (SELECT question_id, CASE WHEN question_id % 2 = 0 THEN 1.0 ELSE average_score END AS average_score, source_score, CASE WHEN question_id % 2 = 0 THEN 0.0 ELSE extra_share END AS x FROM s) SELECT question_id, average_score, CASE WHEN average_score IS NULL THEN NULL ELSE round(least(1.0, average_score + x * 0.2 * coalesce(source_score, 0)), 4) END AS combined_score FROM n")
def j5_merge_rejudged(spark: SparkSession, d: str) -> DataFrame:
    old = _scores(spark, d)
    new = old.filter("question_id % 2 = 0").withColumns({"average_score": F.lit(1.0), "extra_share": F.lit(0.0)})
    return judges.merge_rejudged(old, new, 0.2).select("question_id", "average_score", "combined_score")


@query("WITH " + COMB + ", n AS (SELECT *, question_id % 5 = 0 AND (average_score IS NULL OR abs(0.5 - average_score) >= 0.005) AS ch FROM s) SELECT question_id, ch AS manual, CASE WHEN ch THEN 0.5 ELSE average_score END AS average_score, CASE WHEN ch THEN 0.5 WHEN average_score IS NULL THEN NULL ELSE round(least(1.0, average_score + extra_share * 0.1 * coalesce(source_score, 0)), 4) END AS combined_score FROM n")
def j6_manual_override(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    return judges.manual_override(s, s.filter("question_id % 5 = 0").select("question_id", F.lit(0.5).alias("manual_score"))).select("question_id", "manual", "average_score", "combined_score")


@query("WITH " + v.JUDGES + " SELECT doc_id AS question_id, lang, max(score) FILTER (model = 'quality') AS quality_score, max(reason) FILTER (model = 'quality') AS quality_reason, max(score) FILTER (model = 'toxic') AS toxic_score, max(reason) FILTER (model = 'toxic') AS toxic_reason FROM documents LEFT JOIN judges ON question_id = doc_id GROUP BY 1, 2")
def j7_evaluation_export(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), "lang")
    return judges.evaluation_export(q, v.judges(spark, d), ["quality", "toxic"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'F,m' ELSE o_orderstatus || ',m,F' END AS models FROM orders")
def j8_parse_judge_models(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.array_join(t.name_list(F.concat("o_orderstatus", F.lit(" , m,,F, m "))), ",").alias("models"))


@query("WITH " + COMB + " SELECT count(*) AS questions, count(average_score) AS judged, count(*) FILTER (is_correct) AS correct, round(avg(average_score), 6) AS mean_average_score, round(avg(source_score), 6) AS mean_source_score FROM s")
def j9_evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(judges.evaluation_summary(_scores(spark, d)), "mean_average_score", "mean_source_score")


# ---- experiments ----
@query("SELECT g.o_orderpriority AS group_id, o.o_orderstatus AS dataset_id, o.o_orderkey AS question_id FROM orders o, (SELECT DISTINCT o_orderpriority FROM orders) g")
def x1_work_matrix(spark: SparkSession, d: str) -> DataFrame:
    r = v.results(spark, d)
    return experiments.work_matrix(r.select("group_id").distinct(), r.select("dataset_id", "question_id"))


@query("SELECT o_orderpriority AS group_id, o_orderstatus AS dataset_id, o_orderkey AS question_id, CASE WHEN o_orderkey % 13 = 0 THEN 'missing' WHEN o_orderkey % 4 = 0 THEN 'settings' ELSE 'question' END AS problem FROM orders WHERE o_orderkey % 13 = 0 OR o_orderkey % 4 = 0 OR o_orderkey % 10 = 7")
def x2_check_answers(spark: SparkSession, d: str) -> DataFrame:
    more = {"method": F.lit("basic"), "response_type": F.lit("text"), "answer_reasoning_effort": F.lit("low")}
    r = v.results(spark, d).withColumns(more)
    m = r.select(*experiments.KEY, F.lit("m2").alias("answer_model"), *more, "question", F.when(F.col("question_id") % 10 == 7, "other").otherwise(F.col("correct_answer")).alias("reference_answer"))
    return experiments.check_answers(m, r)


@query("WITH " + v.RESULTS + " SELECT question_id, grade FROM results")
def x3_parse_grade(spark: SparkSession, d: str) -> DataFrame:
    return experiments.with_grade(v.results(spark, d)).select("question_id", "grade")


@query("WITH " + v.RESULTS + " SELECT group_id, count(*) FILTER (grade = 2) AS correct, count(*) FILTER (grade > 0 AND grade < 2) AS partial, count(*) FILTER (grade = 0) AS incorrect, round(sum(grade), 4) AS score_sum FROM results GROUP BY 1")
def x4_grade_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(experiments.grade_counts(experiments.with_grade(v.results(spark, d)), "group_id"), "score_sum", digits=4)


def _totals(r: DataFrame, *by: str) -> DataFrame:
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("question_count"))


@query("WITH " + v.RESULTS + " SELECT group_id, round(avg(source_score), 6) AS average_source_score, round(sum(comb) / count(*), 6) AS combined_accuracy FROM combined GROUP BY 1")
def x5_source_stats(spark: SparkSession, d: str) -> DataFrame:
    r = experiments.with_grade(v.results(spark, d))
    return rounded(experiments.source_stats(r, _totals(r, "group_id")), "average_source_score", "combined_accuracy")


SUMMARY = "count(*) FILTER (actual_answer <> '') AS answered, count(*) FILTER (grade = 2) AS correct, count(*) FILTER (grade > 0 AND grade < 2) AS partial, count(*) FILTER (grade = 0) AS incorrect, round(count(*) FILTER (grade = 2) / count(*), 6) AS accuracy, round(sum(grade) / 2 / count(*), 6) AS score_accuracy, round(sum(comb) / count(*), 6) AS combined_accuracy, round(avg(duration_seconds), 6) AS average_latency_seconds, quantile_disc(duration_seconds, 0.95) AS p95_latency_seconds, round(avg(answer_em), 6) AS average_answer_em, round(avg(answer_f1), 6) AS average_answer_f1"
COLUMNS = ["answered", "correct", "partial", "incorrect", "accuracy", "score_accuracy", "combined_accuracy", "average_latency_seconds", "p95_latency_seconds", "average_answer_em", "average_answer_f1"]
ROUND = ["accuracy", "score_accuracy", "combined_accuracy", "average_latency_seconds", "average_answer_em", "average_answer_f1"]


METHODS = {"1-URGENT": "basic", "2-HIGH": "auto", "3-MEDIUM": "agentic", "4-NOT SPECIFIED": "global", "5-LOW": "local"}
_method = "CASE group_id " + " ".join(f"WHEN '{k}' THEN '{m}'" for k, m in METHODS.items()) + " END"
X6 = f"""{v.RESULTS}, {v.EVIDENCE}, {v.GOLD}, r AS (SELECT *, {_method} AS method, ['basic', 'global', 'local'][k % 3 + 1] AS effective_method FROM combined),
e AS (SELECT DISTINCT ON (question_id, document_id, CASE WHEN pages = [] THEN [rank] ELSE pages END, pages = []) * FROM evidence ORDER BY rank),
pg AS (SELECT question_id, document_id, list_distinct(flatten(list(pages))) AS gp FROM gold GROUP BY 1, 2),
per AS (SELECT e.question_id, count(*) AS n, count(*) FILTER (len(list_intersect(e.pages, pg.gp)) > 0) AS hits, bool_or(pg.gp IS NOT NULL) AS dh FROM e LEFT JOIN pg USING (question_id, document_id) GROUP BY 1),
g AS (SELECT question_id, bool_or(len(pages) > 0) AS paged FROM gold GROUP BY 1),
counted AS (SELECT group_id, question_id FROM r WHERE k % 23 <> 0 AND CASE method WHEN 'auto' THEN effective_method <> 'global' WHEN 'agentic' THEN k % 2 = 0 ELSE method IN ('basic', 'local', 'drift') END),
src AS (SELECT group_id, avg((coalesce(hits, 0) > 0)::INT) AS evidence_hit_rate, avg(CASE WHEN paged THEN CASE WHEN coalesce(n, 0) > 0 THEN hits / n ELSE 0 END END) AS evidence_precision, avg(coalesce(dh, false)::INT) AS document_hit_rate, count(*) FILTER (coalesce(n, 0) = 0) AS no_evidence_count FROM counted JOIN g USING (question_id) LEFT JOIN per USING (question_id) GROUP BY 1),
j AS (SELECT group_id, question_id, unnest(['a', 'b', 'c']) AS model, unnest([k % 3, CASE WHEN k % 7 <> 0 THEN k % 5 / 2 END, NULL]) AS score FROM r),
jm AS (SELECT group_id, round(avg(score) FILTER (model = 'a'), 4) AS judge_a, round(avg(score) FILTER (model = 'b'), 4) AS judge_b FROM j GROUP BY 1), jd AS (SELECT group_id, count(*) AS disagreements FROM (SELECT group_id, question_id FROM j WHERE score IS NOT NULL GROUP BY 1, 2 HAVING min(score) < max(score)) GROUP BY 1),
c AS (SELECT group_id, round(avg(CASE WHEN method <> 'agentic' THEN CASE WHEN method = 'auto' THEN k % 3 + 1 ELSE 1 END END), 6) AS searches, round(avg(k % 4 + 1), 6) AS average_llm_call_count, round(avg((k % 2 = 0)::INT) FILTER (method = 'auto'), 6) AS first_choice_hit_rate, round(avg(k % 4) FILTER (method = 'agentic'), 6) AS steps, round(avg(k % 6) FILTER (method = 'agentic'), 6) AS average_agent_model_calls FROM r GROUP BY 1),
s AS (SELECT group_id, method, {SUMMARY} FROM r GROUP BY 1, 2)"""


@query(f"""WITH {X6} SELECT s.* EXCLUDE (method), coalesce(c.searches, c.steps) AS average_search_steps, c.average_agent_model_calls, c.average_llm_call_count, c.first_choice_hit_rate, jm.judge_a, jm.judge_b, coalesce(jd.disagreements, 0) AS judge_disagreement_count,
  round(evidence_hit_rate, 6) AS evidence_hit_rate, round(evidence_precision, 6) AS evidence_precision, round(document_hit_rate, 6) AS document_hit_rate, coalesce(no_evidence_count, 0) AS no_evidence_count,
  CASE method WHEN 'global' THEN 'unsupported' WHEN 'auto' THEN 'computed_without_global' ELSE 'computed' END AS retrieval_metrics_status
FROM s JOIN c USING (group_id) JOIN jm USING (group_id) LEFT JOIN jd USING (group_id) LEFT JOIN src USING (group_id)""")
def x6_group_summary(spark: SparkSession, d: str) -> DataFrame:
    """Groups of all kinds: plain, routed (some questions to global search), agentic (some without text units) and global."""
    k = F.col("question_id")
    method = F.element_at(F.create_map(*[F.lit(x) for pair in METHODS.items() for x in pair]), F.col("group_id"))
    is_ = lambda m: method == m
    r = experiments.with_grade(v.results(spark, d)).withColumns({
        "effective_method": F.element_at(F.array(*map(F.lit, ("basic", "global", "local"))), (k % 3 + 1).cast("int")), "has_text_units": k % 2 == 0, "retrieval_metrics_status": F.lit(""),
        "search_step_count": F.when(is_("agentic"), k % 4), "agent_call_count": F.when(is_("agentic"), k % 6),
    })
    totals = _totals(r, "group_id").withColumn("method", method)
    items = metrics.evaluate_questions(r.select("question_id", F.lit("x").alias("method"), "duration_seconds"), v.evidence(spark, d), v.gold(spark, d)).join(r.select("question_id", "group_id"), "question_id")
    spent = r.select("group_id", F.when(is_("auto"), k % 3 + 1).when(~is_("agentic"), F.lit(1)).alias("search_count"), (k % 4 + 1).alias("llm_call_count"), *[F.lit(None).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")], F.when(is_("auto"), F.lit("basic")).alias("first_method"), F.when(is_("auto"), k % 2 == 0).alias("first_choice_found"))
    scores = F.array(F.struct(F.lit("a").alias("model"), (k % 3).cast("double").alias("score")), F.struct(F.lit("b").alias("model"), F.when(k % 7 != 0, k % 5 / 2).alias("score")), F.struct(F.lit("c").alias("model"), F.lit(None).cast("double").alias("score")))
    panel = r.select("group_id", "question_id", F.inline(scores))
    out = experiments.group_summary(r, totals, items=items, costs=spent, judges=panel)
    more = ["average_search_steps", "average_agent_model_calls", "average_llm_call_count", "first_choice_hit_rate", "evidence_hit_rate", "evidence_precision", "document_hit_rate"]
    cells = [F.try_element_at("judge_average_scores", F.lit(m)).alias(f"judge_{m}") for m in ("a", "b")]
    return rounded(out, *ROUND, *more).select("group_id", *COLUMNS, *more, *cells, "judge_disagreement_count", "no_evidence_count", "retrieval_metrics_status")


@query("WITH " + v.RESULTS + " SELECT group_id, quantile_disc(duration_seconds, 0.95) AS p95 FROM results GROUP BY 1")
def x7_p95_latency(spark: SparkSession, d: str) -> DataFrame:
    return experiments.p95_latency(v.results(spark, d), "group_id").withColumnRenamed("p95_latency_seconds", "p95")


@query("WITH " + v.RESULTS + ", g AS (SELECT DISTINCT group_id FROM results), s AS (SELECT dataset_id, count(*) AS n FROM results GROUP BY 1), r AS (SELECT group_id, dataset_id, count(*) FILTER (actual_answer <> '') AS answered, count(*) FILTER (grade = 2) AS correct FROM results WHERE question_id % 2 = 0 GROUP BY 1, 2) SELECT g.group_id, s.dataset_id, n AS question_count, coalesce(answered, 0) AS answered, round(coalesce(correct, 0) / n, 6) AS accuracy FROM g CROSS JOIN s LEFT JOIN r ON r.group_id = g.group_id AND r.dataset_id = s.dataset_id")
def x8_dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    r = experiments.with_grade(v.results(spark, d))
    out = experiments.dataset_summary(r.select("group_id").distinct(), r.select("dataset_id", "question_id"), r.filter("question_id % 2 = 0"))
    return rounded(out, "accuracy").select("group_id", "dataset_id", "question_count", "answered", "accuracy")


@query("WITH " + v.RESULTS + " SELECT group_id, dataset_id, question_id FROM results")
def x9_order_results(spark: SparkSession, d: str) -> DataFrame:
    r = v.results(spark, d).select(*experiments.KEY)
    position = lambda c: r.select(c).distinct().filter(F.col(c) != "F").withColumn("position", F.length(c))
    return experiments.order_results(r, position("group_id"), position("dataset_id"), r.select("dataset_id", "question_id", F.col("question_id").alias("position")))


@query("WITH " + v.RESULTS + " SELECT question_id, CASE WHEN question_id % 6 = 0 AND question_id % 23 <> 0 AND (grade IS NULL OR abs(grade - 1.5) >= 0.005) THEN 1.5 ELSE grade END AS grade, manual_override OR (question_id % 6 = 0 AND question_id % 23 <> 0 AND (grade IS NULL OR abs(grade - 1.5) >= 0.005)) AS manual_override FROM results")
def x10_apply_manual_grades(spark: SparkSession, d: str) -> DataFrame:
    r = v.results(spark, d)
    out = experiments.apply_manual_grades(r, r.filter("question_id % 6 = 0").select(*experiments.KEY, F.lit(1.5).alias("manual_grade")))
    return experiments.with_grade(out).select("question_id", "grade", "manual_override")


@query("WITH " + v.RESULTS + ", g AS (SELECT avg(duration_seconds) AS l FROM results GROUP BY group_id) SELECT count(*) AS question_count, count(grade) AS evaluated, round(count(*) FILTER (grade = 2) / count(*), 6) AS accuracy, round(sum(grade) / 2 / count(*), 6) AS score_accuracy, round(avg(answer_em), 6) AS average_answer_em, round((SELECT avg(l) FROM g), 6) AS average_latency_seconds FROM results")
def x11_overall_summary(spark: SparkSession, d: str) -> DataFrame:
    r = experiments.with_grade(v.results(spark, d))
    out = experiments.overall_summary(experiments.group_summary(r, _totals(r, "group_id")), r)
    return rounded(out, "accuracy", "score_accuracy", "average_answer_em", "average_latency_seconds").select("question_count", "evaluated", "accuracy", "score_accuracy", "average_answer_em", "average_latency_seconds")


@query("WITH " + v.RESULTS + " SELECT question_id, CASE WHEN question_id % 2 = 0 THEN 0.5 ELSE grade END AS score, CASE WHEN question_id % 2 = 0 THEN 'panel' ELSE 'own' END AS reason FROM results")
def x12_judge_detail(spark: SparkSession, d: str) -> DataFrame:
    j = F.array(F.struct(F.lit("m1").alias("model"), F.lit(0.5).alias("score"), F.lit("panel").alias("reason")), F.struct(F.lit("m2").alias("model"), F.lit(0.9).alias("score"), F.lit("x").alias("reason")))
    r = experiments.with_grade(v.results(spark, d)).withColumn("judge_scores", F.when(F.col("question_id") % 2 == 0, j)).withColumn("judge_reason", F.lit("own"))
    return experiments.judge_detail(r, "m1", "m1").select("question_id", "score", "reason")


@query("SELECT CAST(c_custkey AS VARCHAR) AS group_id, CASE c_custkey % 4 WHEN 1 THEN 'range basic.k' WHEN 2 THEN 'type basic.k' ELSE 'unknown basic.z' END AS error FROM customer WHERE c_custkey % 4 <> 0")
def x13_validate_parameters(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    p = F.create_map(F.lit("basic"), F.create_map(F.when(k == 3, "z").otherwise("k"), F.when(k == 1, "500").when(k == 2, "1.5").otherwise("10")))
    g = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("group_id"), F.col("c_name").alias("name"), p.alias("strategy_parameters"))
    return experiments.validate_parameters(g, experiments.parameter_specs(spark))


@query("SELECT count(*) AS \"rows\", false AS complete FROM orders")
def x14_run_completeness(spark: SparkSession, d: str) -> DataFrame:
    r = v.results(spark, d)
    return experiments.run_completeness(r, r.count())


@query("WITH " + v.EVIDENCE + " SELECT question_id, count(DISTINCT document_id) + 1 AS n FROM evidence GROUP BY 1")
def x15_evidence_documents(spark: SparkSession, d: str) -> DataFrame:
    e = v.evidence(spark, d)
    q = e.select("question_id").distinct().withColumn("source_documents", F.array(F.lit("gold")))
    return experiments.evidence_documents(q, e).select("question_id", F.size("documents").cast("long").alias("n"))


# ---- costs ----
@query("SELECT o_orderkey AS query_id, CASE WHEN count(l_orderkey) > 0 THEN count(l_orderkey) END AS model_call_count, sum(CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber END) AS prompt_tokens, CASE WHEN count(l_orderkey) = 0 THEN 'unknown_no_llm_calls_recorded' WHEN count(*) FILTER (l_linenumber % 3 <> 0) = count(*) THEN 'measured' WHEN count(*) FILTER (l_linenumber % 3 <> 0) > 0 THEN 'partially_measured' ELSE 'unknown_usage_not_returned' END AS cost_status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def c1_usage_metadata(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"))
    return costs.usage_metadata(table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id")), calls).select("query_id", "model_call_count", "prompt_tokens", "cost_status")


@query("WITH " + v.LOG + " SELECT query_id, search_count, llm_call_count, total_tokens, first_method, first_choice_found FROM costs")
def c2_query_cost(spark: SparkSession, d: str) -> DataFrame:
    return costs.query_cost(v.log(spark, d)).select("query_id", "search_count", "llm_call_count", "total_tokens", "first_method", "first_choice_found")


COST = "count(*) AS query_count, round(avg(search_count), 6) AS average_search_count, round(avg(llm_call_count), 6) AS average_llm_call_count, round(avg(total_tokens), 6) AS average_total_tokens, count(total_tokens) AS measured_query_count, round(avg(first_choice_found::INT), 6) AS first_choice_hit_rate"
COST_COLUMNS = ["query_count", "average_search_count", "average_llm_call_count", "average_total_tokens", "measured_query_count", "first_choice_hit_rate"]


def _cost(df: DataFrame, *by: str) -> DataFrame:
    return rounded(df, "average_search_count", "average_llm_call_count", "average_total_tokens", "first_choice_hit_rate").select(*by, *COST_COLUMNS)


@query(f"WITH {v.LOG} SELECT project_id, {COST} FROM costs GROUP BY 1")
def c3_aggregate_cost(spark: SparkSession, d: str) -> DataFrame:
    return _cost(costs.aggregate_cost(costs.query_cost(v.log(spark, d)), "project_id"), "project_id")


@query(f"WITH {v.LOG} SELECT {COST} FROM costs WHERE source = 'batch' AND started_at >= TIMESTAMP '2024-01-10' AND requested_method = 'auto'")
def c4_cost_report(spark: SparkSession, d: str) -> DataFrame:
    return _cost(costs.cost_report(v.log(spark, d), "batch", "2024-01-10", "auto"))


@query(f"WITH {v.LOG} SELECT {COST} FROM costs WHERE answer IS NOT NULL")
def c5_question_set_cost(spark: SparkSession, d: str) -> DataFrame:
    return _cost(costs.question_set_cost(costs.query_cost(v.log(spark, d))))


@query("WITH " + v.LOG + " SELECT requested_method AS routed_method, count(*) AS questions FROM log GROUP BY 1")
def c6_method_counts(spark: SparkSession, d: str) -> DataFrame:
    return costs.method_counts(v.log(spark, d).withColumnRenamed("requested_method", "routed_method"))


@query("SELECT l_orderkey AS query_id, count(*) AS calls, 'answer' AS stage FROM lineitem GROUP BY 1")
def c7_tag_calls(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.collect_list(F.struct("l_linenumber")).alias("c"))
    return q.withColumn("c", costs.tag_calls(F.col("c"), "answer", "basic")).select("query_id", F.size("c").cast("long").alias("calls"), F.col("c")[0]["stage"].alias("stage"))


# ---- routing and retrieval ----
@query("""WITH k AS (SELECT split_part(p_name, ' ', 1) AS key, min(p_partkey) AS ordinal FROM part GROUP BY 1), a AS (SELECT ordinal, key, i AS position, CASE i WHEN 0 THEN upper(key) WHEN 1 THEN 'part ' || ordinal % 5 ELSE substr(key, 2) END AS term FROM k, range(3) t(i)),
m AS (SELECT p_partkey, term, min((ordinal, position)) AS seen FROM part JOIN a ON contains(p_name, key) AND NOT contains(p_name, term) GROUP BY 1, 2), g AS (SELECT p_partkey, string_agg(term, '; ' ORDER BY seen) AS terms FROM m GROUP BY 1)
SELECT p.p_partkey AS question_id, CASE WHEN terms IS NULL THEN p_name ELSE p_name || chr(10) || 'Related manual terms: ' || terms END AS expanded FROM part p LEFT JOIN g USING (p_partkey)""")
def r1_expand_query(spark: SparkSession, d: str) -> DataFrame:
    """First words of part names are keys, each with three terms (some of which several keys share)."""
    part = table(spark, d, "part")
    keys = part.groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("key")).agg(F.min("p_partkey").alias("ordinal"))
    terms = F.array(F.upper("key"), F.concat(F.lit("part "), F.col("ordinal") % 5), F.substring("key", 2, 10_000))
    aliases = keys.select("ordinal", "key", F.posexplode(terms).alias("position", "term"))
    return retrieval.expand_query(part.select(F.col("p_partkey").alias("question_id"), F.col("p_name").alias("question")), aliases).select("question_id", "expanded")


@query("SELECT doc_id, doc_id % 4 < 3 AS matches FROM documents")
def r2_title_match(spark: SparkSession, d: str) -> DataFrame:
    case = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("doc_id") % 4 + 1).cast("int"))
    q, title = case("如何使用 指紋辨識 功能", "如何使用功能", "螢幕錄影 S Pen", "abc"), case("指紋辨識", "使用功能", "錄影 with pen", "abd xyz")
    return table(spark, d, "documents").select("doc_id", t.title_match(q, title).alias("matches"))


@query("WITH " + v.ANSWERS + " SELECT question_id, false AS unsupported FROM answers WHERE question_id % 2 = 0 UNION ALL SELECT question_id, c1 <> c2 OR c1 = c2 FROM answers WHERE question_id % 2 = 1")
def r3_unsupported_answers(spark: SparkSession, d: str) -> DataFrame:
    a = v.answers(spark, d)
    got = F.when(F.col("question_id") % 2 == 0, t.cited_record_ids(F.col("answer"))).otherwise(F.array(F.lit("none")))
    return a.select("question_id", t.unsupported_answer(F.col("answer"), got).alias("unsupported"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'basic,local,global,drift' WHEN o_orderkey % 3 = 1 THEN 'drift,local,basic,global' ELSE 'basic,local,global,drift' END AS methods FROM orders")
def r4_attempt_order(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    out = retrieval.attempt_order(F.when(k == 0, "basic").otherwise("drift"), F.when(k == 1, F.array(F.lit("drift"), F.lit("local"))).when(k == 2, F.array(F.lit("odd"))))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(out, ",").alias("methods"))


ATTEMPTS = "att AS (SELECT l_orderkey AS query_id, l_linenumber AS attempt, ['basic','local','global','drift'][l_linenumber % 4 + 1] AS method, CASE WHEN l_returnflag = 'R' THEN '' ELSE 'a' || l_linenumber END AS answer, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN (l_linenumber % 4 = 1 AND l_quantity < 7) OR l_quantity < 40 THEN 'not_found' ELSE 'found' END AS status FROM lineitem)"


@query("WITH " + ATTEMPTS + ", one AS (SELECT query_id, min(attempt) FILTER (status = 'found') AS f, min(attempt) FILTER (status = 'not_found') AS n FROM att GROUP BY 1) SELECT query_id, CASE WHEN f IS NOT NULL THEN 'a' || f END AS answer, CASE WHEN f IS NOT NULL THEN 'found' WHEN n IS NOT NULL THEN 'not_found' ELSE 'failed' END AS status FROM one")
def r5_choose_answer(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    a = li.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("attempt"), F.element_at(F.array(*map(F.lit, ("basic", "local", "global", "drift"))), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("method"), F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat(F.lit("a"), "l_linenumber")).alias("answer"), F.lit("").alias("error"), F.col("l_quantity").cast("int").alias("source_count"), (F.col("l_quantity") >= 40).alias("found"))
    return retrieval.choose_answer(a).select("query_id", "answer", "status")


@query(rf"SELECT conv_id, turn, regexp_matches(text || CASE WHEN conv_id % 3 = 0 THEN ' Which one differs? compared' WHEN turn % 5 = 1 THEN '兩者' ELSE '' END, '{t.COMPARISON}') AS comparison FROM conversations")
def r6_is_comparison(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("conv_id") % 3 == 0, " Which one differs? compared").when(F.col("turn") % 5 == 1, "兩者").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", t.is_comparison(F.concat("text", tail)).alias("comparison"))


@query("SELECT user_id AS question_id, event_id AS step, row_number() OVER (PARTITION BY user_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) % 5 ORDER BY event_id) > 1 AS duplicate FROM events")
def r7_duplicate_step(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 5
    s = table(spark, d, "events").select(F.col("user_id").alias("question_id"), F.col("event_id").alias("step"), F.col("event_type").alias("method"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" Find  "), k)).otherwise(F.concat(F.lit("find "), k)).alias("query"))
    return retrieval.duplicate_step(s).select("question_id", "step", "duplicate")


@query("""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), u AS (SELECT vec_id, list_transform(x, lambda y: y / sqrt(list_sum(list_transform(x, lambda z: z * z)))) AS x FROM n),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_dot_product(q.x, v.x) AS score FROM u q, u v WHERE q.vec_id % 50 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 10""")
def r8_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    out = retrieval.vector_topk(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")), 10)
    return out.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def _local(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A query for each supplier finds it and the two next ones; parts are linked to suppliers, units are parts and their sizes."""
    li = table(spark, d, "lineitem")
    rel = li.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("weight")).select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), "weight")
    top = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.posexplode(F.array(*[F.concat(F.lit("s"), F.col("s_suppkey") + i) for i in range(3)])).alias("rank", "entity_id")).withColumn("rank", F.col("rank") + 1)
    units = li.select(F.concat(F.lit("s"), "l_suppkey").alias("entity_id"), F.concat(F.lit("u"), F.col("l_partkey") % 97).alias("unit_id"))
    return retrieval.local_expand(top, rel, units, 5, most=20)


LOCAL = """top AS (SELECT s_suppkey AS query_id, i + 1 AS rank, s_suppkey + i AS s FROM supplier, range(3) t(i))"""


@query(f"WITH {LOCAL}, e AS (SELECT l_suppkey, l_partkey, count(*) AS w FROM lineitem GROUP BY 1, 2), r AS (SELECT query_id, 's' || l_suppkey AS source, 'p' || l_partkey AS target, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, 's' || l_suppkey, 'p' || l_partkey) AS n FROM top JOIN e ON e.l_suppkey = top.s) SELECT query_id, source, target, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 5")
def r9_local_expand(spark: SparkSession, d: str) -> DataFrame:
    return _local(spark, d)[0].select("query_id", "source", "target", "rank")


@query(f"WITH {LOCAL}, u AS (SELECT DISTINCT l_suppkey, 'u' || (l_partkey % 97) AS unit_id FROM lineitem), g AS (SELECT query_id, unit_id, CAST(min(rank) AS INTEGER) AS entity_rank, count(*) AS entities FROM top JOIN u ON u.l_suppkey = top.s GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY entity_rank, entities DESC, unit_id) AS INTEGER) AS position FROM g) SELECT * FROM r WHERE position <= 20")
def r9_local_units(spark: SparkSession, d: str) -> DataFrame:
    return _local(spark, d)[1].select("query_id", "unit_id", "entity_rank", "entities", "position")


@query("WITH " + v.COMMUNITIES + " SELECT community, rank FROM reports WHERE level <= 1")
def r10_reports_at_level(spark: SparkSession, d: str) -> DataFrame:
    c, r = v.communities(spark, d)
    return retrieval.reports_at_level(c, r, 1).select("community", "rank")


def stub_model(row: dict) -> str:
    """Stands in for a model: fails on some rows."""
    if row["question_id"] % 10 == 0:
        raise ValueError("no reply")
    return f"answer {row['question_id']}"


@query("SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 10 <> 0 THEN 'answer ' || o_orderkey END AS result, CASE WHEN o_orderkey % 10 = 0 THEN 'no reply' END AS error FROM orders")
def r11_map_model(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.map_model(table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id")), stub_model, "question_id", parallel=4)


# ---- graph ----
@query("WITH " + v.COMMUNITIES + " SELECT CAST(row_number() OVER (ORDER BY c.community) - 1 AS INTEGER) AS region, c.community, coalesce(r.title, c.title) AS title, round(r.rank, 1) AS rank, coalesce(r.summary, '') AS summary, CAST(members AS INTEGER) AS members FROM communities c LEFT JOIN reports r ON r.community = c.community WHERE c.level = 0")
def g1_top_regions(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_regions(*v.communities(spark, d)).drop("entity_ids")


@query("WITH " + v.ENTITIES + ", " + v.COMMUNITIES + ", o AS (SELECT r_regionkey, row_number() OVER (ORDER BY CAST(r_regionkey AS INTEGER)) - 1 AS region FROM region), m AS (SELECT sn.id, region FROM sn JOIN o ON o.r_regionkey = sn.n_regionkey) SELECT e.id, coalesce(type, 'UNKNOWN') AS type, coalesce(degree, 0) AS degree, CAST(coalesce(region, -1) AS INTEGER) AS region FROM entities e LEFT JOIN m ON m.id = e.id")
def g2_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_nodes(v.entities(spark, d), graph.top_regions(*v.communities(spark, d))).select("id", "type", "degree", "region")


LINKS = v.ENTITIES + ", " + v.RELATIONSHIPS + ", last AS (SELECT title, max(position) AS p FROM entities GROUP BY 1), links AS (SELECT s.p AS source_position, g.p AS target_position, weight FROM relationships r JOIN last s ON s.title = r.source JOIN last g ON g.title = r.target)"


@query("WITH " + LINKS + " SELECT * FROM links")
def g3_graph_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_links(v.relationships(spark, d), v.entities(spark, d)).drop("description")


@query("WITH " + v.ENTITIES + " SELECT coalesce(type, 'UNKNOWN') AS type, count(*) AS entities FROM entities GROUP BY 1")
def g4_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.type_counts(v.entities(spark, d))


@query("WITH " + v.LOG + " SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS entities, (SELECT count(*) FROM documents) AS documents, count(*) AS queries, count(*) FILTER (status = 'COMPLETED') AS completed FROM log")
def g5_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_stats(v.log(spark, d), entities=v.entities(spark, d), documents=table(spark, d, "documents"))


@query("WITH " + v.ENTITIES + " SELECT 1 AS severity, 'isolated' AS kind, count(*) AS n FROM entities WHERE degree IS NULL HAVING count(*) > 0 UNION ALL SELECT 2, 'frontier', count(*) FROM part UNION ALL SELECT 1, 'unreported', count(*) FROM region WHERE r_regionkey % 5 = 3 HAVING count(*) > 0 UNION ALL SELECT 0, 'query', 1 FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 12) WHERE event_type = 'error'")
def g6_graph_alerts(spark: SparkSession, d: str) -> DataFrame:
    regions = graph.top_regions(*v.communities(spark, d))
    return graph.graph_alerts(graph.graph_nodes(v.entities(spark, d), regions), regions, graph.recent_queries(v.log(spark, d))[1]).select("severity", "kind", "n")


@query("SELECT event_id AS ordinal, event_type AS method, value AS duration_seconds FROM events ORDER BY event_id DESC LIMIT 12")
def g7_recent_queries(spark: SparkSession, d: str) -> DataFrame:
    return graph.recent_queries(v.log(spark, d))[1].select("ordinal", "method", "duration_seconds")


@query("WITH " + LINKS + ", both_ AS (SELECT source_position AS position, target_position AS other, weight FROM links UNION ALL SELECT target_position, source_position, weight FROM links), h AS (SELECT position FROM entities ORDER BY coalesce(degree, 0) DESC, id LIMIT 8) SELECT position, other, weight, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY weight DESC, other) AS rank FROM both_ WHERE position IN (SELECT position FROM h))")
def g8_hub_neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = v.entities(spark, d)
    nodes = graph.graph_nodes(e, graph.top_regions(*v.communities(spark, d)))
    top = graph.hubs(nodes).select("id").join(e.select("id", "position"), "id").select("position")
    return graph.neighbours(graph.graph_links(v.relationships(spark, d), e), top).withColumn("rank", F.col("rank").cast("int"))
