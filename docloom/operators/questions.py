"""Question sets, gold labels, reviews and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.operators.sampling import normalize_question

STATUSES = ["PENDING", "RUNNING", "COMPLETED", "FAILED"]
LABELS = ["correct", "partially_correct", "incorrect", "unjudgeable"]
LINES = "\n|；"


def validate_question_set(rows: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """rows(position, number, question, answer_aliases[, extra_fields]) with ``errors``."""
    w = W.partitionBy("number")
    rules = {
        "number": ~F.coalesce(F.col("number") > 0, F.lit(False)),
        "duplicate number": F.col("number").isNotNull() & (F.count(F.lit(1)).over(w) > 1),
        "question": t.strip(F.coalesce("question", F.lit(""))) == "",
        "alias": F.exists(F.coalesce("answer_aliases", F.array().cast("array<string>")), lambda a: a.isNull() | (t.strip(a) == "")),
    }
    if "extra_fields" in rows.columns:
        rules["unknown field"] = F.size(F.array_except("extra_fields", F.lit(fields or []))) > 0
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()])))


def parse_sources(sources: Column) -> Column:
    """array<struct<document_name, pages>> with unique positive pages in first-seen order, named documents only."""
    tidy = F.transform(sources, lambda s: F.struct(t.strip(F.coalesce(s["document_name"], F.lit(""))).alias("document_name"), F.array_distinct(F.filter(F.coalesce(s["pages"], F.array().cast("array<int>")), lambda p: p > 0)).alias("pages")))
    return F.filter(tidy, lambda s: s["document_name"] != "")


def source_errors(sources: Column) -> Column:
    """What is wrong with a list of sources, by kind."""
    blank = F.exists(sources, lambda s: t.strip(F.coalesce(s["document_name"], F.lit(""))) == "")
    pages = F.exists(sources, lambda s: F.exists(F.coalesce(s["pages"], F.array().cast("array<int>")), lambda p: F.coalesce(p < 1, F.lit(True))))
    return F.array_compact(F.array(F.when(blank, F.lit("document")), F.when(pages, F.lit("page"))))


def validate_gold(gold: DataFrame, metadata: DataFrame) -> DataFrame:
    """(question_id, missing): the documents, pages and chunks of the gold rows that the metadata lacks."""
    docs = metadata.select("document_id").distinct()
    pages = metadata.select("document_id", F.explode(F.coalesce("pages", F.array("page"))).alias("page")).distinct()
    chunks = metadata.select("chunk_id").distinct()
    one = gold.select("question_id", "document_id").distinct().join(docs, "document_id", "left_anti").select("question_id", F.concat(F.lit("document "), "document_id").alias("what"))
    two = gold.select("question_id", "document_id", F.explode("pages").alias("page")).distinct().join(docs, "document_id", "left_semi").join(pages, ["document_id", "page"], "left_anti").select("question_id", F.concat(F.lit("page "), "document_id", F.lit(":"), "page").alias("what"))
    three = gold.select("question_id", F.explode("chunk_ids").alias("chunk_id")).distinct().join(chunks, "chunk_id", "left_anti").select("question_id", F.concat(F.lit("chunk "), "chunk_id").alias("what"))
    return one.unionByName(two).unionByName(three).groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_list("what")), ", ").alias("missing"))


def upsert_answers(questions: DataFrame, results: DataFrame, reset: DataFrame | None = None) -> DataFrame:
    """results(question_id, answer, status, error, duration_seconds) replace answer fields; reset unfinished rows."""
    fields = ["answer", "status", "error", "duration_seconds"]
    r = results.select("question_id", F.lit(True).alias("_new"), *[F.col(f).alias(f"_{f}") for f in fields])
    rows = questions.join(r, "question_id", "left")
    if reset is not None:
        rows = rows.join(reset.select("question_id", F.lit(True).alias("_reset")).distinct(), "question_id", "left")
        again = F.col("_reset") & F.col("_new").isNull() & (F.col("status") != "COMPLETED")
    else:
        again = F.lit(False)
    for f in fields:
        empty = F.lit("PENDING") if f == "status" else F.lit(None)
        rows = rows.withColumn(f"_{f}", F.when(F.col("_new"), F.col(f"_{f}")).when(F.coalesce(again, F.lit(False)), empty).otherwise(F.col(f)))
    for f in fields:
        rows = rows.withColumn(f, F.col(f"_{f}"))
    return rows.select(*questions.columns)


def status_summary(questions: DataFrame, statuses: list[str] = STATUSES) -> DataFrame:
    """E5: one row a question set: how many questions have each status, with zeros."""
    return questions.groupBy("question_set_id").pivot("status", statuses).count().na.fill(0)


def select_targets(questions: DataFrame, ids: DataFrame | None = None, resume: bool = False) -> DataFrame:
    """All questions, the listed ones, or (resume) those not finished."""
    out = questions.join(ids.select("question_id").distinct(), "question_id", "left_semi") if ids is not None else questions
    return out.filter(F.col("status").isin("PENDING", "RUNNING")) if resume else out


def unknown_targets(questions: DataFrame, ids: DataFrame) -> DataFrame:
    """Listed ids that no question has."""
    return ids.select("question_id").distinct().join(questions, "question_id", "left_anti")


def source_documents(*lists: Column) -> Column:
    """Document ids over several source lists, as first seen."""
    return F.array_distinct(F.concat(*[F.transform(F.coalesce(x, F.array().cast("array<struct<document_id:string,pages:array<int>>>")), lambda s: s["document_id"]) for x in lists]))


def review_records(questions: DataFrame, reviews: DataFrame) -> DataFrame:
    """All questions with their newest saved label."""
    w = W.partitionBy("question_id").orderBy(F.desc("reviewed_at"))
    newest = reviews.filter(F.col("human_label").isin(LABELS)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("question_id", "human_label", "reviewer_note", "reviewed_at")
    return questions.join(newest, "question_id", "left")


def review_progress(records: DataFrame) -> DataFrame:
    """Reviewed and total questions."""
    return records.agg(F.count("human_label").alias("reviewed"), F.count(F.lit(1)).alias("total"))


def save_cases(cases: DataFrame, queries: DataFrame) -> DataFrame:
    """Cases and a new one for each completed, answered query that has none."""
    new = queries.filter("status = 'COMPLETED' and trim(coalesce(answer, '')) <> ''").join(cases.select("query_id"), "query_id", "left_anti")
    new = new.dropDuplicates(["query_id"])
    return cases.select("query_id", "question", "answer", "note").unionByName(new.select("query_id", "question", "answer", F.lit("").alias("note")))


def recent_manual(log: DataFrame, n: int = 50, chars: int = 60) -> DataFrame:
    """The newest manual queries, with clipped questions."""
    rows = log.filter(F.coalesce("source", F.lit("manual")) == "manual").orderBy(F.desc_nulls_last("started_at"), F.desc("query_id")).limit(min(n, 50))
    clip = F.when(F.length("question") > chars, F.concat(F.substring("question", 1, chars), F.lit("…"))).otherwise(F.col("question"))
    return rows.withColumn("question", clip)


def check_edit(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, value): ids only on one side, blank and duplicate normalised questions."""
    ids = old.select("question_id", F.lit(1).alias("_a")).join(new.select("question_id", F.lit(1).alias("_b")), "question_id", "full_outer").filter("_a is null or _b is null").select(F.lit("id").alias("kind"), F.col("question_id").alias("value"))
    norm = new.select("question_id", normalize_question(F.coalesce("question", F.lit(""))).alias("n"))
    blank = norm.filter("n = ''").select(F.lit("blank").alias("kind"), F.col("question_id").alias("value"))
    twice = norm.filter("n <> ''").groupBy("n").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.lit("duplicate").alias("kind"), F.col("n").alias("value"))
    return ids.unionByName(blank).unionByName(twice)


def parse_source_cell(rows: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(question_id, cell) of 'document: 1, 2' records (or JSON) as source rows, and the records that are wrong.

    old(question_id, document_id, pages, chunk_ids): chunk ids stay if document and pages are unchanged.
    """
    json = F.from_json("cell", "array<struct<document_name:string,pages:array<int>>>")
    is_json = F.startswith(F.col("cell"), F.lit("["))
    texts = F.filter(F.transform(F.split("cell", LINES), t.strip), lambda x: x != "")
    flat = rows.filter(~is_json).select("question_id", F.posexplode(texts).alias("position", "r"))
    head = t.strip(F.regexp_extract("r", r"(?s)^(.*):[^:]*$", 1))
    pages = F.filter(F.transform(F.split(F.substring_index("r", ":", -1), ","), t.strip), lambda p: p != "")
    flat = flat.select("question_id", "position", "r", head.alias("document_id"), pages.alias("p"))
    ok = F.contains("r", F.lit(":")) & (F.col("document_id") != "") & (F.size("p") > 0) & F.forall("p", lambda p: F.coalesce(p.try_cast("int") >= 1, F.lit(False)))
    good = flat.filter(ok).select("question_id", "position", "document_id", F.array_distinct(F.transform("p", lambda p: p.try_cast("int"))).alias("pages"))
    nested = rows.filter(is_json).select("question_id", F.posexplode(parse_sources(json)).alias("position", "s")).select("question_id", "position", F.col("s.document_name").alias("document_id"), "s.pages")
    o = old.select("question_id", "document_id", "pages", "chunk_ids")
    out = good.unionByName(nested).join(o, ["question_id", "document_id", "pages"], "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))
    return out, flat.filter(~F.coalesce(ok, F.lit(False))).select("question_id", "position", F.col("r").alias("record"))
