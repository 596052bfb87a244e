"""Search and model-call costs from query logs (C1-C7). An unknown count is null, never 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLAIN_METHODS = ["local", "global", "drift", "basic"]
MEANS = ["search_count", "llm_call_count", "prompt_tokens", "completion_tokens", "total_tokens"]


def usage_metadata(queries: DataFrame, calls: DataFrame) -> DataFrame:
    """Per query the number of calls, tokens of the measured ones, and how far it was measured."""
    m = F.col("prompt_tokens").isNotNull()
    sums = calls.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(m).alias("k"), F.sum("prompt_tokens").alias("p"), F.sum(F.when(m, F.coalesce("completion_tokens", F.lit(0)))).alias("c"))
    status = F.when(F.col("n").isNull(), "unknown_no_llm_calls_recorded").when(F.col("k") == F.col("n"), "measured").when(F.col("k") > 0, "partially_measured").otherwise("unknown_usage_not_returned")
    return queries.select("query_id").join(sums, "query_id", "left").select("query_id", F.col("n").alias("model_call_count"), F.col("p").alias("prompt_tokens"), F.col("c").alias("completion_tokens"), status.alias("cost_status"))


def query_cost(log: DataFrame) -> DataFrame:
    """log(query_id, requested_method, attempts array<struct<method, status>>, search_step_count, llm_calls array,
    model_call_count, prompt_tokens, completion_tokens) to search count, calls, tokens, first method and its success."""
    n = F.size(F.coalesce("attempts", F.array().cast("array<struct<method:string,status:string>>")))
    searches = F.when(n > 0, n).when(F.col("search_step_count").isNotNull(), F.col("search_step_count")).when(F.col("requested_method").isin(PLAIN_METHODS), 1)
    known = lambda c: F.when(F.col("llm_calls").isNotNull(), F.col(c))
    first = F.get("attempts", F.lit(0))
    return log.select(
        *[c for c in log.columns if c not in (*MEANS, "attempts", "llm_calls", "search_step_count", "model_call_count", "first_method", "first_choice_found")],
        searches.cast("int").alias("search_count"), known("model_call_count").alias("llm_call_count"), known("prompt_tokens").alias("prompt_tokens"), known("completion_tokens").alias("completion_tokens"),
        (known("prompt_tokens") + F.coalesce(known("completion_tokens"), F.lit(0))).alias("total_tokens"),
        F.when(n > 0, first["method"]).alias("first_method"), F.when(n > 0, first["status"] == "found").alias("first_choice_found"),
    )


def aggregate_cost(costs: DataFrame, *by: str) -> DataFrame:
    """Means that skip nulls, measured queries, hit rate of the first choice, and counts a first method."""
    routed = F.col("first_choice_found").isNotNull()
    cells = costs.groupBy(*by, "first_method").agg(
        F.count(F.lit(1)).alias("n"), F.count("total_tokens").alias("measured"), F.count_if(routed).alias("first"), F.count_if("first_choice_found").alias("found"),
        *[F.sum(m).alias(f"s_{m}") for m in MEANS], *[F.count(m).alias(f"n_{m}") for m in MEANS],
    )
    # the methods are few: a second level folds them into one row
    mean = lambda m: F.when(F.sum(f"n_{m}") > 0, F.sum(f"s_{m}") / F.sum(f"n_{m}")).alias(f"average_{m}")
    entry = F.when(F.col("first") > 0, F.struct(F.coalesce("first_method", F.lit("")).alias("method"), F.struct("first", "found").alias("counts")))
    return cells.groupBy(*by).agg(F.sum("n").alias("query_count"), *[mean(m) for m in MEANS], F.sum("measured").alias("measured_query_count"), F.when(F.sum("first") > 0, F.sum("found") / F.sum("first")).alias("first_choice_hit_rate"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("first_choice_by_method"))


def cost_report(log: DataFrame, source: str | None = None, since: str | None = None, method: str | None = None) -> DataFrame:
    """C4: C2 and C3 over the log rows of a source, from a time on, of a requested method (else the method)."""
    if source is not None:
        log = log.filter(F.col("source") == source)
    if since is not None:
        log = log.filter(F.col("started_at") >= F.lit(since).cast("timestamp"))
    if method is not None:
        log = log.filter(F.coalesce("requested_method", "method") == method)
    return aggregate_cost(query_cost(log))


def question_set_cost(questions: DataFrame) -> DataFrame:
    """C3 over the answered questions, whose cost columns are stored."""
    return aggregate_cost(questions.filter("trim(coalesce(answer, '')) <> ''"))


def method_counts(questions: DataFrame) -> DataFrame:
    """Questions a routed strategy."""
    return questions.filter("routed_method is not null and routed_method <> ''").groupBy("routed_method").agg(F.count(F.lit(1)).alias("questions"))


def tag_calls(calls: F.Column, stage: str, method: str) -> F.Column:
    """Every call record with its stage and method."""
    return F.transform(calls, lambda c: c.withField("stage", F.lit(stage)).withField("method", F.lit(method)))
