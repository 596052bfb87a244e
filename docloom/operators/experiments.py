"""Experiment analysis over groups, question sets and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.operators import metrics
from docloom.operators.costs import aggregate_cost
from docloom.operators.ordering import nearest_rank
from docloom.sources.scratch import kept

KEY = ["group_id", "dataset_id", "question_id"]
SETTINGS = ["answer_model", "method", "response_type", "answer_reasoning_effort"]
AVERAGES = ["source_score", "answer_em", "answer_f1", "answer_term_hit", "answer_term_coverage"]
# ---- fixed values: strategies whose evidence has pages, routed and agentic groups, marks of results ----
EVIDENCE_METHODS, AUTO, AGENTIC = ["local", "basic", "drift"], "auto", "agentic"
NOT_COMPUTABLE = "不可計算："
# ---- (strategy, parameter, type, default, least, most) ----
PARAMETER_SPECS = [
    ("local", "community_level", "int", "2", 0.0, 10.0), ("local", "text_unit_prop", "float", "0.5", 0.0, 1.0),
    ("local", "community_prop", "float", "0.15", 0.0, 1.0), ("local", "conversation_history_max_turns", "int", "5", 0.0, 50.0),
    ("local", "top_k_entities", "int", "10", 1.0, 100.0), ("local", "top_k_relationships", "int", "10", 1.0, 100.0),
    ("local", "max_context_tokens", "int", "12000", 100.0, 100000.0),
    ("global", "community_level", "int", "2", 0.0, 10.0), ("global", "dynamic_community_selection", "bool", "false", None, None),
    ("global", "max_context_tokens", "int", "12000", 100.0, 100000.0), ("global", "data_max_tokens", "int", "12000", 100.0, 100000.0),
    ("global", "map_max_length", "int", "1000", 100.0, 10000.0), ("global", "reduce_max_length", "int", "2000", 100.0, 10000.0),
    ("global", "dynamic_search_threshold", "int", "1", 0.0, 100.0), ("global", "dynamic_search_keep_parent", "bool", "false", None, None),
    ("global", "dynamic_search_num_repeats", "int", "1", 1.0, 10.0), ("global", "dynamic_search_use_summary", "bool", "false", None, None),
    ("global", "dynamic_search_max_level", "int", "2", 0.0, 10.0),
    ("drift", "community_level", "int", "2", 0.0, 10.0), ("drift", "n_depth", "int", "3", 1.0, 10.0),
    ("drift", "drift_k_followups", "int", "20", 1.0, 100.0), ("drift", "primer_folds", "int", "5", 1.0, 50.0),
    ("drift", "local_search_text_unit_prop", "float", "0.9", 0.0, 1.0), ("drift", "local_search_community_prop", "float", "0.1", 0.0, 1.0),
    ("drift", "local_search_top_k_mapped_entities", "int", "10", 1.0, 100.0), ("drift", "local_search_top_k_relationships", "int", "10", 1.0, 100.0),
    ("drift", "local_search_max_data_tokens", "int", "12000", 100.0, 100000.0), ("drift", "local_search_temperature", "float", "0.0", 0.0, 2.0),
    ("drift", "local_search_top_p", "float", "1.0", 0.0, 1.0), ("drift", "local_search_n", "int", "1", 1.0, 10.0),
    ("basic", "k", "int", "10", 1.0, 100.0), ("basic", "max_context_tokens", "int", "12000", 100.0, 100000.0),
]
# ---- end of fixed values ----


def work_matrix(groups: DataFrame, questions: DataFrame) -> DataFrame:
    """Every group with every question of every set. The groups are the short side of the product."""
    small = F.broadcast(groups) if groups.limit(10_001).count() <= 10_000 else groups
    return questions.crossJoin(small)


def check_answers(matrix: DataFrame, results: DataFrame) -> DataFrame:
    """Work rows with ``problem``: missing, settings (model, method, format, effort) or question changed."""
    r = results.select(*KEY, *[F.col(c).alias(f"_{c}") for c in (*SETTINGS, "question", "correct_answer", "actual_answer")])
    rows = matrix.join(r, KEY, "left")
    blank = t.strip(F.coalesce("_actual_answer", F.lit(""))) == ""
    settings = F.lit(False)
    for c in SETTINGS:
        settings = settings | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    text = ~F.col("question").eqNullSafe(F.col("_question")) | ~F.col("reference_answer").eqNullSafe(F.col("_correct_answer"))
    problem = F.when(blank, "missing").when(settings, "settings").when(text, "question")
    return rows.withColumn("problem", problem).filter("problem is not null").select(*KEY, "problem")


def with_grade(results: DataFrame) -> DataFrame:
    """The mixed grade column on the 0-2 scale."""
    return results.withColumn("grade", t.parse_grade(F.col("evaluation_result")))


def grade_aggregates() -> list[F.Column]:
    """Full, partial and wrong counts and the sum."""
    g = F.col("grade")
    return [F.count_if(g == 2).alias("correct"), F.count_if((g > 0) & (g < 2)).alias("partial"), F.count_if(g == 0).alias("incorrect"), F.coalesce(F.sum("grade"), F.lit(0.0)).alias("score_sum")]


def grade_counts(results: DataFrame, *by: str) -> DataFrame:
    return results.groupBy(*by).agg(*grade_aggregates())


def combined_grade(weight: float = 0.1) -> F.Column:
    """A row's grade on 0-1 with its source bonus; manual rows get none; ungraded ones count 0."""
    share = F.when(F.coalesce("manual_override", F.lit(False)), 0.0).otherwise(F.coalesce("extra_share", F.lit(0.0)))
    return F.coalesce(t.combined_score(F.col("grade") / 2, F.col("source_score"), share, weight), F.lit(0.0))


def source_stats(results: DataFrame, totals: DataFrame, weight: float = 0.1, *by: str) -> DataFrame:
    """Mean source score, and combined accuracy over all questions. totals(*by, question_count)."""
    by = by or ("group_id",)
    out = results.groupBy(*by).agg(F.avg("source_score").alias("average_source_score"), F.sum(combined_grade(weight)).alias("_sum"))
    return totals.join(out, list(by), "left").select(*by, "average_source_score", F.when(F.col("question_count") > 0, F.coalesce("_sum", F.lit(0.0)) / F.col("question_count")).alias("combined_accuracy"))


def p95_latency(results: DataFrame, *by: str, column: str = "duration_seconds") -> DataFrame:
    """(*by, p95_latency_seconds): nearest-rank 95th percentile of the known durations."""
    return nearest_rank(results, list(by), column, 0.95, "p95_latency_seconds")


def counts_for_sources(method: Column) -> Column:
    """Is a result measured against gold sources? Its group's strategy must map to pages: for routed groups the one that
    was used, for agentic ones any text unit found; failed results and those marked as not computable don't count."""
    ok = (F.coalesce("status", F.lit("")) != "failed") & ~F.startswith(F.coalesce("retrieval_metrics_status", F.lit("")), F.lit(NOT_COMPUTABLE))
    used = F.when(method == AUTO, F.coalesce(F.col("effective_method").isin(EVIDENCE_METHODS), F.lit(False))).when(method == AGENTIC, F.coalesce("has_text_units", F.lit(False)))
    return ok & F.coalesce(used, method.isin(EVIDENCE_METHODS), F.lit(False))


def group_summary(results: DataFrame, totals: DataFrame, weight: float = 0.1, items: DataFrame | None = None, costs: DataFrame | None = None, judges: DataFrame | None = None, judge: bool = True, by: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """One row a group (or group and set) of totals: counts, accuracies, latency and metric means; those
    without results too.

    totals(*by, question_count[, method]). items: metrics.evaluate_questions() rows with the group; with a
    ``method`` they count where counts_for_sources() says so, and ``retrieval_metrics_status`` tells why they
    don't. costs: query_cost() rows with the group. judges(*by, question_id, model, score): means by judge and
    questions on which judges differ. Without a judge accuracies are null. Results may have
    search_step_count and agent_call_count; steps stand in where no search count is known.
    """
    blank = t.strip(F.coalesce("actual_answer", F.lit(""))) == ""
    have = set(results.columns)
    extra = [F.avg(c).alias(n) for c, n in (("search_step_count", "_steps"), ("agent_call_count", "average_agent_model_calls")) if c in have]
    out = results.groupBy(*by).agg(F.count_if(~blank).alias("answered"), *grade_aggregates(), F.sum(combined_grade(weight)).alias("_combined"), F.avg("duration_seconds").alias("average_latency_seconds"), *extra, *[F.avg(c).alias(f"average_{c}") for c in AVERAGES if c in have])
    rows = totals.join(out, list(by), "left").join(p95_latency(results, *by), list(by), "left")
    n = F.col("question_count")
    share = lambda c: F.when((n > 0) & F.lit(judge), c / n)
    zero = {c: 0 for c in ("answered", "correct", "partial", "incorrect", "score_sum", "_combined")}
    rows = rows.na.fill(zero).withColumn("accuracy", share(F.col("correct"))).withColumn("score_accuracy", share(F.col("score_sum") / 2)).withColumn("combined_accuracy", share(F.col("_combined"))).drop("_combined")
    if items is not None:
        if "method" in totals.columns:
            group = results.drop("method").join(totals.select(*by, "method"), list(by))
            counted = kept(group.filter(counts_for_sources(F.col("method"))).select(*by, "question_id").distinct())
            items = items.join(counted, [*by, "question_id"], "left_semi")
            rows = rows.join(counted.groupBy(*by).agg(F.count(F.lit(1)).alias("_counted")), list(by), "left")
            mapped = F.col("method").isin([*EVIDENCE_METHODS, AUTO, AGENTIC])
            none = F.when(F.col("method") == AGENTIC, "no_page_evidence").otherwise("no_results")
            status = F.when(~mapped, "unsupported").when(F.col("_counted").isNull(), none).when(F.col("method") == AUTO, "computed_without_global").otherwise("computed")
            rows = rows.withColumn("retrieval_metrics_status", status).drop("_counted")
        rows = rows.join(metrics.source_metrics(items, *by), list(by), "left").na.fill({"no_evidence_count": 0})
    if costs is not None:
        rows = rows.join(aggregate_cost(costs, *by), list(by), "left")
    searches = [c for c in ("average_search_count", "_steps") if c in rows.columns]
    if searches:
        rows = rows.withColumn("average_search_steps", F.coalesce(*searches)).drop("_steps")
    if judges is not None:
        known = judges.filter("score is not null")
        means = known.groupBy(*by, "model").agg(F.round(F.avg("score"), 4).alias("mean"))
        # the judges of a run are few
        means = means.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "mean")))).alias("judge_average_scores"))
        differ = known.groupBy(*by, "question_id").agg((F.min("score") < F.max("score")).alias("differ")).groupBy(*by).agg(F.count_if("differ").alias("judge_disagreement_count"))
        rows = rows.join(means, list(by), "left").join(differ, list(by), "left").na.fill({"judge_disagreement_count": 0})
        rows = rows.withColumn("judge_average_scores", F.coalesce("judge_average_scores", F.create_map().cast("map<string,double>")))
    return rows


def dataset_summary(groups: DataFrame, questions: DataFrame, results: DataFrame, weight: float = 0.1) -> DataFrame:
    """group_summary() of every (group, question set), also those without results."""
    sets = questions.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("question_count"))
    return group_summary(results, work_matrix(groups.select("group_id"), sets), weight, by=("group_id", "dataset_id"))


def order_results(results: DataFrame, groups: DataFrame, sets: DataFrame, questions: DataFrame) -> DataFrame:
    """By position of group, set and question, unknown last, then id."""
    rows = results.join(groups.select("group_id", F.col("position").alias("_g")), "group_id", "left").join(sets.select("dataset_id", F.col("position").alias("_s")), "dataset_id", "left").join(questions.select("dataset_id", "question_id", F.col("position").alias("_q")), ["dataset_id", "question_id"], "left")
    order = [F.asc_nulls_last(c) for c in ("_g", "_s", "_q")]
    return rows.orderBy(*order, "group_id", "dataset_id", "question_id").select(*results.columns)


def apply_manual_grades(results: DataFrame, edits: DataFrame, step: float = 0.005) -> DataFrame:
    """edits(*key, manual_grade) override grades that differ by ``step`` or more, not of failed judgements."""
    rows = with_grade(results).join(edits.select(*KEY, F.col("manual_grade").alias("_m")), KEY, "left")
    ok = F.col("_m").between(0, 2) & (F.coalesce("status", F.lit("")) != "failed") & (F.col("grade").isNull() | (F.abs(F.col("grade") - F.col("_m")) >= step))
    ok = F.coalesce(ok, F.lit(False))
    out = rows.withColumn("evaluation_result", F.when(ok, F.col("_m").cast("string")).otherwise(F.col("evaluation_result").cast("string"))).withColumn("manual_override", ok | F.coalesce("manual_override", F.lit(False)))
    return out.drop("_m", "grade")


def finite_mean(column: str) -> F.Column:
    """X11: mean of the finite values."""
    c = F.col(column).cast("double")
    return F.avg(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c))


def overall_summary(groups: DataFrame, results: DataFrame, weight: float = 0.1) -> DataFrame:
    """X11: one row: totals over the groups; hit rates and latency as means over groups, metrics as means over rows."""
    over_groups = ["evidence_hit_rate", "evidence_precision", "document_hit_rate", "average_latency_seconds"]
    g = groups.agg(F.sum("question_count").alias("question_count"), *[finite_mean(c).alias(c) for c in over_groups if c in groups.columns])
    r = results.agg(*grade_aggregates(), F.count_if(F.col("answer_em").isNotNull() & F.col("answer_f1").isNotNull()).alias("classic_evaluated"), F.sum(combined_grade(weight)).alias("_combined"), *[finite_mean(c).alias(f"average_{c}") for c in AVERAGES])
    n = F.col("question_count")
    out = g.crossJoin(r)
    return out.withColumn("evaluated", F.col("correct") + F.col("partial") + F.col("incorrect")).withColumn("accuracy", F.when(n > 0, F.col("correct") / n)).withColumn("score_accuracy", F.when(n > 0, F.col("score_sum") / 2 / n)).withColumn("combined_accuracy", F.when(n > 0, F.coalesce("_combined", F.lit(0.0)) / n)).drop("_combined")


def judge_detail(results: DataFrame, model: str, run_model: str) -> DataFrame:
    """One judge's rows; results without judge rows count as one of the run's judge."""
    rows = results.select(*KEY, "grade", "judge_reason", F.explode_outer("judge_scores").alias("j"))
    out = rows.select(*KEY, F.coalesce("j.model", F.lit(run_model)).alias("model"), F.when(F.col("j").isNull(), F.col("grade")).otherwise(F.col("j.score")).alias("score"), F.when(F.col("j").isNull(), F.col("judge_reason")).otherwise(F.col("j.reason")).alias("reason"))
    return out.filter(F.col("model") == model)


def parameter_specs(spark) -> DataFrame:
    return spark.createDataFrame(PARAMETER_SPECS, "strategy string, name string, kind string, default string, least double, most double")


def validate_parameters(groups: DataFrame, specs: DataFrame) -> DataFrame:
    """(group_id, error): repeated or blank ids, unknown strategies or parameters, wrong types and ranges."""
    ids = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or group_id is null or group_id = ''").select("group_id", F.lit("id").alias("error"))
    names = groups.filter("trim(coalesce(name, '')) = ''").select("group_id", F.lit("name").alias("error"))
    cells = groups.select("group_id", F.explode("strategy_parameters").alias("strategy", "p")).select("group_id", "strategy", F.explode("p").alias("name", "value"))
    met = cells.join(F.broadcast(specs), ["strategy", "name"], "left")  # a fixed table
    v = F.col("value").try_cast("double")
    wrong = F.when(F.col("kind").isNull(), "unknown").when((F.col("kind") == "bool") & ~F.lower("value").isin("true", "false"), "type").when((F.col("kind") != "bool") & v.isNull(), "type").when((F.col("kind") == "int") & (v != F.floor(v)), "type").when((F.col("kind") != "bool") & ~v.between(F.col("least"), F.col("most")), "range")
    bad = met.withColumn("e", wrong).filter("e is not null").select("group_id", F.concat_ws(" ", "e", F.concat_ws(".", "strategy", "name")).alias("error"))
    return ids.unionByName(names).unionByName(bad)


def with_default_parameters(groups: DataFrame, specs: DataFrame) -> DataFrame:
    """Each group's parameters of its own strategy with defaults filled in."""
    d = specs.groupBy(F.col("strategy").alias("method")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "default")))).alias("_d"))
    own = F.coalesce(F.try_element_at("strategy_parameters", F.col("method")), F.create_map().cast("map<string,string>"))
    rest = F.map_filter("_d", lambda k, _: ~F.map_contains_key(own, k))
    return groups.join(F.broadcast(d), "method", "left").withColumn("parameters", F.map_concat(own, F.coalesce(rest, F.create_map().cast("map<string,string>")))).drop("_d")


def run_completeness(results: DataFrame, expected: int) -> DataFrame:
    """One row: are all expected rows there and answered?"""
    blank = t.strip(F.coalesce("actual_answer", F.lit(""))) == ""
    return results.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(~blank), F.lit(False)).alias("ok")).select(F.col("n").alias("rows"), ((F.col("n") == expected) & F.col("ok")).alias("complete"))


def evidence_documents(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Documents of each question's sources, then of its evidence by rank, as first seen."""
    e = evidence.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "document_id"))).alias("_e"))
    got = F.transform(F.coalesce("_e", F.array().cast("array<struct<rank:int,document_id:string>>")), lambda x: x["document_id"])
    return questions.join(e, "question_id", "left").select("question_id", t.first_seen(F.coalesce("source_documents", F.array().cast("array<string>")), got).alias("documents"))
