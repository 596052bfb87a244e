"""Source sampling and generated questions (Q1-Q13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.operators.ordering import numbered_within
from docloom.sources.scratch import kept

CONTENT_TYPES = ["all", "diagnostic", "procedure", "specification", "general"]
CJK = "[㐀-䶿一-鿿]"


def available_sections(chunks: DataFrame) -> DataFrame:
    """Q1: distinct (section_id, section_name) by section id, case apart."""
    return chunks.select("section_id", "section_name").distinct().orderBy(F.lower("section_id"), "section_id", "section_name")


def scan_sources(chunks: DataFrame, sections: list[str] | None = None, page_from: int | None = None, page_to: int | None = None, content_type: str = "all", minimum: int = 1) -> DataFrame:
    """Q4: chunks by section, page, length and class, without contents pages."""
    if content_type not in CONTENT_TYPES or minimum < 1 or (page_from and page_to and page_from > page_to):
        raise ValueError("unknown content type, or a range that holds nothing")
    text = t.strip(F.col("text"))
    keep = (F.length(text) >= minimum) & ~t.is_table_of_contents(text)
    if sections:
        keep &= F.col("section_id").isin(sections)
    if page_from is not None:
        keep &= F.col("page") >= page_from
    if page_to is not None:
        keep &= F.col("page") <= page_to
    kind = t.classify_content(text)
    if content_type != "all":
        keep &= kind == content_type
    return chunks.filter(keep).withColumns({"content_type": kind, "character_count": F.length(text)}).orderBy(F.lower("section_id"), F.lower("document_id"), "page", "block_id", "chunk_id")


def sample_sources(chunks: DataFrame, n: int, seed: int) -> DataFrame:
    """Q5: exactly n rows, the same for the same seed: those of the smallest hashes; ValueError if there are fewer."""
    picked = chunks.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "chunk_id")), "chunk_id").limit(n)
    if len(picked.select("chunk_id").take(n)) < n:
        raise ValueError(f"fewer than {n} candidates")
    return picked


def representative_samples(chunks: DataFrame, questions: int) -> DataFrame:
    """Q6: up to min(24, max(12, 2 * questions)) rows of each document, evenly spaced in its order."""
    limit = min(24, max(12, 2 * questions))
    rows = numbered_within(chunks, ["document_id"], ["page", "block_id", "chunk_id"], "_k", "_n").withColumn("_k", F.col("_k") - 1)
    at = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(limit - 1), 0).cast("long"))
    return rows.filter((F.col("_n") <= limit) | F.array_contains(at, F.col("_k"))).drop("_k", "_n")


def normalize_question(text: Column) -> Column:
    """Q7: NFKC, case folded, letters and digits only."""
    return F.regexp_replace(t.nfkc_casefold(text), r"(?U)[^\p{L}\p{N}]", "")


def dedupe_questions(generated: DataFrame, per_document: int, rounds: int = 3) -> DataFrame:
    """Q8: over rounds, the first of each normalised question over all documents, so many a document.

    generated(round, document_id, position, question). A round asks the documents that are short of their
    target after the rounds before, and takes what no accepted question equals; it may give a document more
    than its target, as the generator may. What a document that is not asked would give claims nothing.
    """
    rows = kept(generated.withColumn("_norm", normalize_question(F.col("question"))).filter("_norm <> ''"))
    accepted = None
    for k in range(1, rounds + 1):
        asked = rows.filter(F.col("round") == k)
        if accepted is not None:
            full = accepted.groupBy("document_id").agg(F.count(F.lit(1)).alias("_got")).filter(F.col("_got") >= per_document)
            asked = asked.join(full, "document_id", "left_anti").join(accepted.select("_norm"), "_norm", "left_anti").select(*rows.columns)
        first = F.row_number().over(W.partitionBy("_norm").orderBy("document_id", "position"))
        new = asked.withColumn("_n", first).filter("_n = 1").drop("_n")
        accepted = kept(new if accepted is None else accepted.unionByName(new))
    return accepted.drop("_norm")


def validate_generated(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Q9: rows(question_id, question, reference_answer, question_source_ids, answer_source_ids, difficulty) with ``errors``."""
    known = samples.select(F.col("sample_id").alias("_id"), "section_id")
    cells = rows.select("question_id", F.lit("q").alias("side"), F.explode_outer(F.array_distinct("question_source_ids")).alias("_id")).unionByName(rows.select("question_id", F.lit("a").alias("side"), F.explode_outer(F.array_distinct("answer_source_ids")).alias("_id")))
    met = cells.join(known, "_id", "left")
    side = lambda s: F.col("side") == s
    checks = met.groupBy("question_id").agg(F.count_if(side("q") & F.col("section_id").isNull()).alias("_bad_q"), F.count_if(side("a") & F.col("section_id").isNull()).alias("_bad_a"), F.count_distinct(F.when(side("a"), F.col("_id"))).alias("_n"), F.count_distinct(F.when(side("a"), F.col("section_id"))).alias("_sections"))
    blank = lambda c: t.strip(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = {
        "no question": blank("question"), "no answer": blank("reference_answer"),
        "not Chinese": ~F.coalesce(F.col("question").rlike(CJK) & F.col("reference_answer").rlike(CJK), F.lit(False)),
        "unknown question source": F.col("_bad_q") > 0, "unknown answer source": F.col("_bad_a") > 0,
        "sources for difficulty": ((F.col("difficulty") == "simple") & (F.col("_n") != 1)) | ((F.col("difficulty") == "medium") & (F.col("_n") < 2)) | ((F.col("difficulty") == "cross_section") & (F.col("_sections") < 2)),
    }
    return rows.join(checks, "question_id").withColumn("errors", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).drop("_bad_q", "_bad_a", "_n", "_sections")


def gold_from_sources(cited: DataFrame) -> DataFrame:
    """Q10: cited(question_id, ordinal, document_id, page, chunk_id): one row a document, pages and chunks as first seen."""
    items = F.array_sort(F.collect_list(F.struct("ordinal", "page", "chunk_id")))
    out = cited.groupBy("question_id", "document_id").agg(items.alias("i"), F.min("ordinal").alias("position"))
    return out.select("question_id", "position", "document_id", F.array_distinct(F.transform("i", lambda x: x["page"])).alias("pages"), F.array_distinct(F.transform("i", lambda x: x["chunk_id"])).alias("chunk_ids"))


def assign_question_ids(rows: DataFrame, existing: DataFrame | None = None, partition: str = "question_set_id") -> DataFrame:
    """Q11: ids Q0001.. by position; appended rows go on after the largest number in use."""
    out = numbered_within(rows, [partition], ["position"], "_n")
    if existing is not None:
        last = existing.groupBy(partition).agg(F.max(F.regexp_extract("question_id", r"^Q(\d+)$", 1).try_cast("int")).alias("_last"))
        out = out.join(last, partition, "left").withColumn("_n", F.col("_n") + F.coalesce("_last", F.lit(0))).drop("_last")
    text = F.col("_n").cast("string")
    return out.withColumn("question_id", F.concat(F.lit("Q"), F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text))).drop("_n")


def approved_questions(batch: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q12: the batch with its review states updated, and its approved rows."""
    u = updates.select("question_id", F.col("generation_status").alias("_status"))
    out = batch.join(u, "question_id", "left").withColumn("generation_status", F.coalesce("_status", "generation_status")).drop("_status")
    return out, out.filter("generation_status = 'approved'")


def source_payload(samples: DataFrame, most: int = 2500, by: str = "document_id", batch: int = 200) -> DataFrame:
    """Q13: (by, batch, sources): JSON lists of sources with their text cut, of up to ``batch`` each, numbered from 1.

    In the order of the sample ids; a document of any size is as many rows as it needs.
    """
    cell = F.struct("sample_id", "document_id", "page", "section_id", F.substring("text", 1, most).alias("text"))
    rows = numbered_within(samples.select(by, "sample_id", cell.alias("_c")), [by], ["sample_id"], "_n")
    number = F.floor((F.col("_n") - 1) / batch).cast("int") + 1
    cells = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_c"))), lambda x: x["_c"])
    return rows.groupBy(by, number.alias("batch")).agg(F.to_json(cells).alias("sources"))
