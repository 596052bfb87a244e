"""Judge verdicts and scores."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as t

LEVELS, CORRECT_FROM, MANUAL_STEP = 5, 0.8, 0.005
VERDICT = "question_id string, level int, reason string, extra boolean"


@F.pandas_udf(T.StringType())
def first_json_object(text: pd.Series) -> pd.Series:
    """The first JSON object in free text, or null."""
    decoder = json.JSONDecoder()

    def find(x):
        at = x.find("{") if isinstance(x, str) else -1
        while at >= 0:
            try:
                found, _ = decoder.raw_decode(x, at)
                return json.dumps(found, ensure_ascii=False)
            except ValueError:
                at = x.find("{", at + 1)
        return None

    return text.map(find)


def parse_verdicts(raw: DataFrame) -> DataFrame:
    """raw(question_id, model, response): level, reason and extra flag, or an error.

    The verdict must be of the question, the level a whole number from 0 to 5, the reason not empty;
    the extra flag counts at level 3 only.
    """
    cells = raw.withColumn("_json", first_json_object(F.col("response")))
    v = F.from_json("_json", "question_id string, level string, reason string, extra_content_error boolean")
    rows = cells.withColumn("v", v)
    level = F.when(F.col("v.level").rlike(r"^\d+$"), F.col("v.level").try_cast("int"))
    error = (
        F.when(F.col("_json").isNull(), "no JSON object").when(~F.col("v.question_id").eqNullSafe(F.col("question_id")), "another question")
        .when(~F.coalesce(level.between(0, LEVELS), F.lit(False)), "level").when(t.strip(F.coalesce("v.reason", F.lit(""))) == "", "reason")
    )
    out = rows.withColumn("error", error)
    ok = F.col("error").isNull()
    return out.select("question_id", "model", F.when(ok, level).alias("level"), F.when(ok, t.strip(F.col("v.reason"))).alias("reason"), F.when(ok, F.coalesce((level == 3) & F.col("v.extra_content_error"), F.lit(False))).alias("extra_content_error"), "error")


def rubric_score(level: Column) -> Column:
    """A level on the 0-1 scale (twice that is the 0-2 scale)."""
    return F.round(level / LEVELS, 4)


def is_correct(score: Column) -> Column:
    return score >= CORRECT_FROM


def question_scores(judges: DataFrame, *key: str) -> DataFrame:
    """Mean over judges that succeeded, share that saw only added content, reasons in the order of models."""
    key = key or ("question_id",)
    shown = F.when(F.col("score").isNotNull(), F.concat("model", F.lit(": "), F.coalesce("reason", F.lit("")))).otherwise(F.concat("model", F.lit(": failed "), F.coalesce("error", F.lit(""))))
    out = judges.groupBy(*key).agg(F.round(F.avg("score"), 4).alias("average_score"), F.coalesce(F.avg(F.when(F.col("score").isNotNull(), F.col("extra_content_error").cast("double"))), F.lit(0.0)).alias("extra_share"), F.count("score").alias("judged"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("model", shown.alias("s")))), lambda x: x["s"]), "\n").alias("reasons"))
    return out.withColumn("is_correct", F.coalesce(is_correct(F.col("average_score")), F.lit(False)))


def judge_averages(judges: DataFrame) -> DataFrame:
    """Mean score of each judge."""
    return judges.filter("score is not null").groupBy("model").agg(F.round(F.avg("score"), 4).alias("average_score"), F.count(F.lit(1)).alias("judged"))


def judge_disagreements(judges: DataFrame) -> DataFrame:
    """One row: questions whose successful judges differ."""
    return judges.groupBy("question_id").agg(F.count_distinct("score").alias("n")).agg(F.count_if(F.col("n") > 1).alias("disagreements"))


def with_combined(scores: DataFrame, weight: float = 0.1) -> DataFrame:
    """scores(average_score, source_score, extra_share[, manual]) with combined_score."""
    share = F.when(F.coalesce("manual", F.lit(False)), 0.0).otherwise(F.col("extra_share")) if "manual" in scores.columns else F.col("extra_share")
    return scores.withColumn("combined_score", t.combined_score(F.col("average_score"), F.col("source_score"), share, weight))


def merge_rejudged(previous: DataFrame, new: DataFrame, weight: float = 0.1) -> DataFrame:
    """New rows replace old ones by question; all combined scores follow the run's weight."""
    keep = previous.join(new.select("question_id"), "question_id", "left_anti").select(*[c for c in previous.columns if c != "combined_score"])
    return with_combined(keep.unionByName(new.select(*keep.columns)), weight)


def manual_override(scores: DataFrame, edits: DataFrame, weight: float = 0.1) -> DataFrame:
    """edits(question_id, manual_score) override where they differ by 0.005 or more; such rows get no bonus."""
    e = edits.filter(F.col("manual_score").between(0, 1)).select("question_id", F.col("manual_score").alias("_m"))
    rows = scores.join(e, "question_id", "left")
    if "manual" not in scores.columns:
        rows = rows.withColumn("manual", F.lit(False))
    change = F.col("_m").isNotNull() & (F.col("average_score").isNull() | (F.abs(F.col("_m") - F.col("average_score")) >= MANUAL_STEP))
    rows = rows.withColumn("manual", change | F.col("manual")).withColumn("average_score", F.when(change, F.round("_m", 4)).otherwise(F.col("average_score"))).withColumn("is_correct", F.coalesce(is_correct(F.col("average_score")), F.lit(False)))
    return with_combined(rows.drop("_m"), weight)


def evaluation_export(questions: DataFrame, judges: DataFrame, models: list[str], *others: DataFrame) -> DataFrame:
    """Questions with one score and one reason column a judge model, and what else is known by question_id."""
    wide = judges.groupBy("question_id").pivot("model", models).agg(F.first("score").alias("score"), F.first("reason").alias("reason"))
    out = questions.join(wide, "question_id", "left")
    for o in others:
        out = out.join(o, "question_id", "left")
    return out


def evaluation_summary(scores: DataFrame) -> DataFrame:
    """Counts and means that ignore nulls."""
    means = [F.avg(c).alias(f"mean_{c}") for c in ("average_score", "source_score", "combined_score", "answer_em", "answer_f1", "answer_term_hit", "answer_term_coverage") if c in scores.columns]
    return scores.agg(F.count(F.lit(1)).alias("questions"), F.count("average_score").alias("judged"), F.count_if("is_correct").alias("correct"), *means)
