"""Answer and source metrics over tables (A3-A6, A12-A16); the text metrics are in functions.text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.sources.scratch import written

TOLERANCE, DOCUMENT_ONLY = 1, 0.5
METRICS = {"answer_em": t.exact_match, "answer_f1": t.char_f1, "answer_term_hit": t.term_hit, "answer_term_coverage": t.term_coverage}


def _pages(row: str = "") -> F.Column:
    p = f"{row}." if row else ""
    return F.when(F.size(F.coalesce(f"{p}pages", F.array().cast("array<int>"))) > 0, F.col(f"{p}pages")).otherwise(F.array_compact(F.array(f"{p}page")))


def cited_evidence(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """A3: text units that the answer cites by record id or En, or that were added; a cited number that is no
    retrieved record counts as a page number."""
    units = evidence.filter(F.coalesce("source_type", F.lit("text_unit")) == "text_unit")
    # a window keeps the order in which most evidence comes, so that it is neither read nor sorted twice
    got = units.withColumn("_got", F.collect_set("context_id").over(W.partitionBy("question_id")))
    a = answers.select("question_id", t.cited_record_ids(F.col("answer")).alias("_ids"), t.cited_evidence_ids(F.col("answer")).alias("_es"))
    rows = got.join(a, "question_id").withColumn("_pages", F.array_except("_ids", "_got"))
    pages = F.transform(_pages(), lambda p: p.cast("string"))
    hit = (F.coalesce("added_by", F.lit("")) != "") | F.array_contains("_ids", F.col("context_id")) | F.array_contains("_es", F.col("evidence_id")) | F.arrays_overlap(pages, F.col("_pages"))
    return rows.filter(hit).select(*evidence.columns)


def cited_sources(cited: DataFrame) -> DataFrame:
    """A4: cited pages of each (question, document), sorted."""
    pages = cited.select("question_id", "document_id", F.explode_outer(_pages()).alias("page"))
    return pages.groupBy("question_id", "document_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def source_score(answers: DataFrame, evidence: DataFrame, gold: DataFrame, document_only: float = DOCUMENT_ONLY, equal: DataFrame | None = None) -> DataFrame:
    """A5: (question_id, source_score): recall of gold pages that a cited page of the document is within one page of
    (or equals by ``equal``(document_id, page, other)); a document alone, ``document_only``; null without gold or units."""
    cited = cited_evidence(answers, evidence)
    at = written(cited.select("question_id", "document_id", F.explode_outer(_pages()).alias("c")).distinct(), "cited")
    docs = at.select("question_id", "document_id").distinct()
    g_docs = gold.select("question_id", "document_id").distinct()
    hit = g_docs.join(docs, ["question_id", "document_id"]).select("question_id").distinct().withColumn("_doc", F.lit(True))
    pages = gold.select("question_id", "document_id", F.explode("pages").alias("page")).distinct()
    # band join: a cited page serves the gold pages next to it
    near = at.filter("c is not null").select("question_id", "document_id", F.explode(F.sequence(F.col("c") - TOLERANCE, F.col("c") + TOLERANCE)).alias("page"))
    if equal is not None:
        same = at.join(equal.select("document_id", F.col("other").alias("c"), "page"), ["document_id", "c"]).select("question_id", "document_id", "page")
        near = near.unionByName(same)
    met = pages.join(near.distinct().withColumn("_hit", F.lit(1)), ["question_id", "document_id", "page"], "left")
    recall = met.groupBy("question_id").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("_recall"))
    units = evidence.filter(F.coalesce("source_type", F.lit("text_unit")) == "text_unit").select("question_id").distinct().withColumn("_units", F.lit(True))
    base = answers.select("question_id").join(g_docs.select("question_id").distinct().withColumn("_gold", F.lit(True)), "question_id", "left").join(units, "question_id", "left").join(recall, "question_id", "left").join(hit, "question_id", "left")
    doc = F.coalesce("_doc", F.lit(False))
    score = F.when(F.col("_gold").isNull() | F.col("_units").isNull(), None).when(F.col("_recall").isNull(), doc.cast("double")).when((F.col("_recall") == 0) & doc, document_only).otherwise(F.round("_recall", 4))
    return base.select("question_id", score.alias("source_score"))


def answer_metrics(pairs: DataFrame) -> DataFrame:
    """pairs(id, predicted_answer, answer, answer_aliases) with the best of each metric over the answers."""
    truths = F.concat(F.array("answer"), F.coalesce("answer_aliases", F.array().cast("array<string>")))
    return pairs.select("id", *[t.best_over_truths(m, F.col("predicted_answer"), truths).alias(k) for k, m in METRICS.items()])


def pairing_errors(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """(kind, id): ids that are null, repeated, or on one side only."""
    out = None
    for name, df in (("prediction", predictions), ("truth", truths)):
        bad = df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("id is null or n > 1").select(F.lit(f"{name} id").alias("kind"), "id")
        out = bad if out is None else out.unionByName(bad)
    one = predictions.select("id", F.lit(1).alias("a")).join(truths.select("id", F.lit(1).alias("b")), "id", "full_outer").filter("a is null or b is null").select(F.lit("unpaired").alias("kind"), "id")
    return out.unionByName(one)


def corpus_metrics(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """Macro averages of the four metrics over the pairs; zeros if there are none."""
    rows = answer_metrics(predictions.join(truths, "id"))
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.avg(k), F.lit(0.0)).alias(k) for k in METRICS])


def dedupe_pages(evidence: DataFrame) -> DataFrame:
    """The first row of each (question, document, set of pages); rows without pages stay apart by id."""
    pages = F.array_sort(F.array_distinct(_pages()))
    name = F.when(F.size(pages) == 0, F.coalesce(F.nullif("evidence_id", F.lit("")), F.nullif("text_unit_id", F.lit("")), F.col("rank").cast("string")))
    w = W.partitionBy("question_id", "document_id", "_pages", "_name").orderBy("rank")
    return evidence.withColumn("_pages", pages).withColumn("_name", name).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_pages", "_name", "_n")


def with_relevance(evidence: DataFrame, gold: DataFrame) -> DataFrame:
    """Evidence with ``relevant``: does it share a document and a page with the gold?"""
    g = gold.groupBy("question_id", "document_id").agg(F.flatten(F.collect_list("pages")).alias("_gold"))
    rows = evidence.join(g, ["question_id", "document_id"], "left")
    return rows.withColumn("relevant", F.coalesce(F.arrays_overlap(_pages(), F.col("_gold")), F.lit(False))).withColumn("in_document", F.col("_gold").isNotNull()).drop("_gold")


def evaluate_questions(questions: DataFrame, evidence: DataFrame, gold: DataFrame, supported: list[str] | None = None) -> DataFrame:
    """Metrics of each question; null where its method has no page evidence. questions(question_id, method, duration_seconds)."""
    rows = with_relevance(dedupe_pages(evidence), gold).groupBy("question_id").agg(F.count(F.lit(1)).alias("retrieved"), F.count_if("relevant").alias("relevant"), F.bool_or("in_document").alias("in_document"))
    g = gold.groupBy("question_id").agg(F.bool_or(F.size("pages") > 0).alias("_paged"))
    out = questions.join(rows, "question_id", "left").join(g, "question_id", "left")
    ok = F.col("method").isin(supported) if supported is not None else F.lit(True)
    n, r = F.coalesce("retrieved", F.lit(0)), F.coalesce("relevant", F.lit(0))
    precision = F.when(F.col("_paged"), F.when(n > 0, r / n).otherwise(0.0))
    return out.select("question_id", "method", F.when(ok, r > 0).alias("evidence_hit"), F.when(ok, precision).alias("evidence_precision"), F.when(ok, F.coalesce("in_document", F.lit(False))).alias("document_hit"), n.alias("retrieved"), r.alias("relevant"), F.col("_paged").isNotNull().alias("has_gold"), "duration_seconds")


def source_metrics(items: DataFrame, *by: str) -> DataFrame:
    """Hit rate, page precision, document hit rate and questions without evidence, of the questions with gold."""
    ok = items.filter(F.col("has_gold") & F.col("evidence_hit").isNotNull())
    return ok.groupBy(*by).agg(F.avg(F.col("evidence_hit").cast("double")).alias("evidence_hit_rate"), F.avg("evidence_precision").alias("evidence_precision"), F.avg(F.col("document_hit").cast("double")).alias("document_hit_rate"), F.count_if(F.col("retrieved") == 0).alias("no_evidence_count"))
