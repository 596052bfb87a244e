"""Document preparation (P1-P21): pages to sections to chunk records, and the state of documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.operators.ordering import carried, placed, with_neighbours
from docloom.sources.tables import replace_documents

FORMAT_VERSION, CONTINUATION_PAGES = 1, 2
BODY_TOP, BODY_BOTTOM, HEADER_BAND = 0.08, 0.95, 0.10
MARGINS = ["header_ignore_percent", "footer_ignore_percent", "left_ignore_percent", "right_ignore_percent"]


def margin_errors(options: DataFrame) -> DataFrame:
    """Options outside 0-100, or opposite sides that leave nothing."""
    low = [F.when(~F.col(m).between(0, 100), F.lit(m)) for m in MARGINS]
    both = [F.when(F.col(a) + F.col(b) >= 100, F.lit(f"{a}+{b}")) for a, b in (MARGINS[:2], MARGINS[2:])]
    return options.withColumn("errors", F.array_compact(F.array(*low, *both))).filter(F.size("errors") > 0).select("document_id", "errors")


def clip_blocks(blocks: DataFrame, options: DataFrame | None = None) -> DataFrame:
    """Blocks that lie inside the page area that the margins leave (none: the whole page)."""
    if options is None:
        return blocks.filter((F.col("y1") > BODY_TOP * F.col("page_height")) & (F.col("y0") < BODY_BOTTOM * F.col("page_height")))
    rows = blocks.join(options.select("document_id", *MARGINS), "document_id", "left")
    share = lambda m: F.coalesce(F.col(m), F.lit(0.0)) / 100
    inside = (
        (F.col("y0") >= share(MARGINS[0]) * F.col("page_height"))
        & (F.col("y1") <= (1 - share(MARGINS[1])) * F.col("page_height"))
        & (F.col("x0") >= share(MARGINS[2]) * F.col("page_width"))
        & (F.col("x1") <= (1 - share(MARGINS[3])) * F.col("page_width"))
    )
    return rows.filter(inside).select(*blocks.columns)


def header_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks in the band where running headers stand."""
    return blocks.filter(F.col("y0") < HEADER_BAND * F.col("page_height"))


def select_page_range(pages: DataFrame, options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages within each document's 0-based inclusive range; and ranges that are wrong."""
    last = pages.groupBy("document_id").agg((F.max("page")).alias("last_page"))
    spans = last.join(options.select("document_id", "start_page", "end_page"), "document_id", "left").select("document_id", "last_page", F.coalesce("start_page", F.lit(0)).alias("start_page"), F.coalesce("end_page", "last_page").alias("end_page"))
    bad = (F.col("start_page") < 0) | (F.col("start_page") > F.col("end_page")) | (F.col("end_page") > F.col("last_page"))
    good = spans.filter(~bad).select("document_id", "start_page", "end_page")
    kept = pages.join(good, "document_id").filter(F.col("page").between(F.col("start_page"), F.col("end_page")))
    return kept.select(*pages.columns), spans.filter(bad)


def split_sections(pages: DataFrame, carry: str | None = None) -> DataFrame:
    """P5: (document_id, page, block, heading, text); a page starts with the heading that the one before ended with.

    Headings and blocks are found within a page's row; only the last heading of each page is carried on,
    over ranges of pages. ``carry``: a column that is true for pages whose headings are not carried on
    (failed pages).
    """
    lines = lambda: t.lines_of(F.coalesce("text", F.lit("")))
    last = t.let(F.filter(lines(), t.is_section_heading), lambda heads: F.get(heads, F.size(heads) - 1))
    end = F.when(F.coalesce(F.col(carry), F.lit(False)), None).otherwise(last) if carry else last
    key = ["document_id", "page"]
    ends = pages.select(*key, t.strip(end).alias("end")).groupBy(*key).agg(F.max("end").alias("end"))
    before = carried(placed(ends, ["document_id"], ["page"]), ["document_id"], ["page"], "end", "before").select(*key, "before")

    def blocks(ls: Column) -> Column:
        starts = t.let(F.filter(F.transform(ls, lambda x, i: F.when(t.is_section_heading(x), i)), lambda i: i.isNotNull()), lambda heads: F.when(F.get(heads, F.lit(0)) == 0, heads).otherwise(F.concat(F.array(F.lit(0)), heads)))
        return t.let(starts, lambda at: F.transform(at, lambda a, k: F.struct(
            F.when((k > 0) | t.is_section_heading(F.get(ls, a)), t.strip(F.get(ls, a))).alias("own"),
            t.strip(F.array_join(F.slice(ls, a + 1, F.coalesce(F.get(at, k + 1), F.size(ls)) - a), "\n")).alias("text"),
        )))

    full = pages.select(*key, "text").join(before, key)
    parts = full.select(*key, "before", F.posexplode(F.filter(t.let(lines(), blocks), lambda b: b["text"] != "")).alias("k", "b"))
    return parts.select(*key, (F.col("k") + 1).alias("block"), F.coalesce("b.own", "before", F.lit("")).alias("heading"), F.col("b.text").alias("text"))


def build_chunk_records(sections: DataFrame, project: str = "default", version: int = FORMAT_VERSION) -> DataFrame:
    """Chunk records with ids, section path and title."""
    stem, block = t.safe_stem(F.col("document_id")), F.concat(F.lit("b"), F.lpad(F.col("block").cast("string"), 2, "0"))
    section = t.section_identifier(F.col("heading"), stem)
    name = F.when(F.col("heading") != "", F.col("heading")).otherwise(F.col("document_id"))
    chunk = F.concat_ws("-", stem, F.concat(F.lit("p"), F.lpad(F.col("page").cast("string"), 4, "0")), block)
    path = F.when(F.col("heading") != "", F.concat_ws(" > ", "document_id", "heading")).otherwise(F.col("document_id"))
    title = F.concat(F.col("document_id"), F.lit(" - Page "), F.col("page"), F.when(F.col("heading") != "", F.concat(F.lit(" - "), F.col("heading"))).otherwise(""))
    return sections.select(chunk.alias("id"), chunk.alias("chunk_id"), F.lit(project).alias("project_id"), section.alias("section_id"), name.alias("section_name"), path.alias("section_path"), title.alias("title"), "text", "document_id", "page", block.alias("block_id"), F.lit(version).alias("sectioning_version"))


def apply_page_edits(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Manual text over extracted text; source_changed if the extraction is another than at the time of the edit."""
    e = edits.filter(F.col("text").isNotNull() | F.col("reviewed")).select("document_id", "page", F.col("text").alias("_edited"), F.col("extracted_text").alias("_was"), F.col("reviewed").alias("_seen"))
    rows = pages.join(e, ["document_id", "page"], "left")
    edited = F.col("_edited").isNotNull()
    return rows.select("document_id", "page", F.coalesce("_edited", "text").alias("text"), F.col("text").alias("extracted_text"), edited.alias("edited"), F.coalesce("_seen", F.lit(False)).alias("reviewed"), (edited & ~F.col("_was").eqNullSafe(F.col("text"))).alias("source_changed"))


def page_reviews(documents: DataFrame, pages: DataFrame, marks: DataFrame, status: str | None = None) -> DataFrame:
    """One row for each selected page: text, source class and flags. marks: (document_id, page, kind of error/fallback/vision)."""
    spans = documents.select("document_id", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    kinds = marks.groupBy("document_id", "page").agg(F.collect_set("kind").alias("kinds"))
    rows = spans.join(pages, ["document_id", "page"], "left").join(kinds, ["document_id", "page"], "left")
    has = lambda k: F.coalesce(F.array_contains("kinds", k), F.lit(False))
    empty = t.strip(F.coalesce("text", F.lit(""))) == ""
    source = F.when(has("error"), "error").when(has("fallback"), "fallback").when(has("vision"), "vision").when(empty, "empty").otherwise("text")
    out = rows.select("document_id", "page", F.coalesce("text", F.lit("")).alias("text"), source.alias("source"), F.coalesce("reviewed", F.lit(False)).alias("reviewed"), F.coalesce("edited", F.lit(False)).alias("edited"), F.coalesce("source_changed", F.lit(False)).alias("source_changed"))
    checks = {None: F.lit(True), "unreviewed": ~F.col("reviewed"), "reviewed": F.col("reviewed"), "edited": F.col("edited"), "changed": F.col("source_changed"), "problem": F.col("source").isin("error", "fallback", "empty")}
    return out.filter(checks[status])


def document_status(pages: DataFrame, run_at: Column | None = None) -> DataFrame:
    """P10: counts and status of each document; errors win over warnings (empty pages)."""
    empty = F.col("error").isNull() & (t.strip(F.coalesce("text", F.lit(""))) == "")
    out = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(empty).alias("empty_pages"), F.count_if(F.col("error").isNotNull()).alias("error_pages"), *([F.max("processed_at").alias("processed_at")] if "processed_at" in pages.columns else []))
    status = F.when(F.col("error_pages") > 0, "PROCESSED_WITH_ERRORS").when(F.col("empty_pages") > 0, "PROCESSED_WITH_WARNINGS").otherwise("PROCESSED")
    out = out.withColumn("status", status)
    return out.withColumn("processed_at", F.coalesce("processed_at", run_at)) if run_at is not None and "processed_at" in out.columns else out


def preprocess_report(documents: DataFrame) -> DataFrame:
    """Totals of a run over the documents' rows."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c) if c in documents.columns else F.lit(0).alias(c)
    return documents.agg(n("pages"), F.coalesce(F.sum(F.col("pages") - F.col("empty_pages") - F.col("error_pages")), F.lit(0)).alias("successful_pages"), n("empty_pages"), n("error_pages"), n("edited_pages"), n("vision_pages"), n("vision_tokens"), F.count_if(F.col("error_pages") > 0).alias("documents_with_errors"), F.min_by("abort_reason", F.when(F.col("abort_reason").isNotNull(), F.col("document_id"))).alias("abort_reason") if "abort_reason" in documents.columns else F.lit(None).cast("string").alias("abort_reason"))


def project_status(documents: DataFrame) -> DataFrame:
    """EMPTY, INDEXED, STALE, READY or UPLOADED from the documents' flags."""
    flags = documents.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("preprocessed") & F.col("indexed")).alias("all_"), F.bool_or("indexed").alias("some"), F.bool_or("preprocessed").alias("ready"))
    return flags.select(F.when(F.col("n") == 0, "EMPTY").when(F.col("all_"), "INDEXED").when(F.col("some"), "STALE").when(F.col("ready"), "READY").otherwise("UPLOADED").alias("status"))


def merge_transcriptions(pages: DataFrame, fallback: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages with recovered text, pages still failing with the newest error, recovered pages)."""
    done = new.filter(F.col("error").isNull())
    key = ["document_id", "page"]
    merged = pages.join(done.select(*key), key, "left_anti").select(*key, "text").unionByName(done.select(*key, "text"))
    newest = new.filter(F.col("error").isNotNull()).select(*key, F.col("error").alias("_new"))
    left = fallback.join(done.select(*key), key, "left_anti").join(newest, key, "full_outer").select(*key, F.coalesce("_new", "error").alias("error"))
    return merged, left, done.select(*key)


def merge_continuation(chunks: DataFrame) -> DataFrame:
    """A page's first block joins the page before if it goes on with its section; two pages at most.

    A merged record never starts another merge: the page that was added does not begin with its
    heading, and a merged record is full. So the row before decides, and no state is carried.
    """
    first_line = lambda c: F.get(F.filter(F.transform(t.lines_of(F.coalesce(c, F.lit(""))), t.strip), lambda x: x != ""), F.lit(0))
    rows = chunks.withColumn("_first", F.coalesce(first_line(F.col("text")), F.lit(""))).withColumn("_name", t.strip(F.coalesce("section_name", F.lit(""))))
    order = ["page", "block_id"]
    met = with_neighbours(placed(rows, ["document_id"], order), ["document_id"], order, ["section_id", "section_path", "page", "block_id", "text", "_first", "_name"])

    def joins(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        """Does the row b go on with the row a before it?"""
        same = (
            a("section_id").eqNullSafe(b("section_id")) & a("section_path").eqNullSafe(b("section_path"))
            & F.contains(F.coalesce(b("section_path"), F.lit("")), F.lit(" > ")) & (b("page") == a("page") + 1) & (b("block_id") == "b01")
            & (a("_first") == a("_name")) & (b("_first") != b("_name"))
        )
        return F.coalesce(same, F.lit(False))

    before, after = (lambda c, side=side: F.col(f"{side}.{c}") for side in ("_before", "_after"))
    marked = met.withColumn("_joins", F.col("_before").isNotNull() & joins(before, F.col)).withColumn("_next", F.col("_after").isNotNull() & joins(F.col, after))
    title = F.concat(F.col("document_id"), F.lit(" - Pages "), F.col("page"), F.lit(", "), after("page"), F.lit(" - "), F.col("section_name"))
    out = marked.filter(~F.col("_joins"))
    text = F.when(F.col("_next"), t.strip(F.concat_ws("\n\n", F.col("text"), after("text")))).otherwise(F.col("text"))
    pages = F.when(F.col("_next"), F.array("page", after("page"))).otherwise(F.array("page"))
    keep = [c for c in chunks.columns if c not in ("text", "pages", "title")]
    return out.select(*keep, text.alias("text"), pages.alias("pages"), F.when(F.col("_next"), title).otherwise(F.col("title") if "title" in chunks.columns else F.lit(None).cast("string")).alias("title"))


def needs_refresh(chunks: DataFrame, version: int = FORMAT_VERSION) -> DataFrame:
    """One row: does any record have another format version?"""
    return chunks.agg(F.coalesce(F.bool_or(~F.col("sectioning_version").eqNullSafe(F.lit(version))), F.lit(False)).alias("needs_refresh"))


def input_changed(expected: DataFrame, current: DataFrame) -> DataFrame:
    """One row: do the two tables differ in any row (an order column makes order count)?"""
    a, b = expected.select(*sorted(expected.columns)), current.select(*sorted(expected.columns))
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg((F.count(F.lit(1)) > 0).alias("changed"))


def indexed_flag(documents: DataFrame, snapshot: DataFrame) -> DataFrame:
    """A document is indexed if it was processed at the time that the last snapshot has."""
    s = snapshot.select("document_id", F.col("processed_at").alias("_at"))
    return documents.join(s, "document_id", "left").withColumn("indexed", F.col("processed_at").isNotNull() & F.col("processed_at").eqNullSafe(F.col("_at"))).drop("_at")


def detect_language(pages: DataFrame) -> DataFrame:
    """The main language of each document, or null."""
    counts = pages.groupBy("document_id").agg(*[F.sum(c).alias(k) for k, c in t.script_counts(F.coalesce("text", F.lit(""))).items()])
    return counts.select("document_id", t.language_of({k: F.col(k) for k in ("kana", "hangul", "han", "latin", "traditional", "simplified")}).alias("language"))


def language_sample(units: DataFrame, most: int = 200, chars: int = 400) -> DataFrame:
    """One row (script, excerpt) of the first units by ordinal; the excerpt is of the first long one."""
    first = units.filter(F.col("text").isNotNull()).orderBy("ordinal").limit(most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n")
    long = F.min_by("text", F.when(F.length("text") > 200, F.col("ordinal")))
    out = first.agg(joined.alias("joined"), long.alias("long"))
    return out.select(t.text_script(F.col("joined")).alias("script"), F.substring(F.coalesce("long", "joined"), 1, chars).alias("excerpt"))


def questions_to_rewrite(questions: DataFrame, sample: DataFrame) -> DataFrame:
    """Questions whose script differs from the corpus'. The sample is one row."""
    return questions.crossJoin(F.broadcast(sample.select("script"))).withColumn("needs_rewrite", t.needs_rewrite(F.col("question"), F.col("script"))).drop("script")


def serialize_page_items(items: Column) -> Column:
    """P20: the data of array<struct<type, data>> joined: a blank line next to tables, else a line break."""
    full = F.filter(F.transform(items, lambda x: F.struct(x["type"].alias("type"), t.strip(x["data"]).alias("data"))), lambda x: x["data"] != "")
    glue = lambda x, i: F.when(i == 0, F.lit("")).when((x["type"] == "table") | (F.get(full, i - 1)["type"] == "table"), F.lit("\n\n")).otherwise(F.lit("\n"))
    return F.array_join(F.transform(full, lambda x, i: F.concat(glue(x, i), x["data"])), "")


def page_item_errors(items: Column) -> Column:
    """P20: is any item of an unknown type or without data?"""
    return items.isNull() | F.exists(items, lambda x: F.coalesce(~x["type"].isin("text", "table", "diagram"), F.lit(True)) | x["data"].isNull())


def source_catalogue(sources: DataFrame) -> DataFrame:
    """The first row of each chunk id in input order."""
    return sources.withColumn("_n", F.row_number().over(W.partitionBy("chunk_id").orderBy("ordinal"))).filter("_n = 1").drop("_n")


def prepare(pages: DataFrame, options: DataFrame, edits: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """The whole preparation of pages as one plan; ``old`` chunks of other documents stay."""
    kept, _ = select_page_range(pages, options)
    plain = kept.withColumn("text", t.strip_leading_folio(F.col("text")))
    chunks = build_chunk_records(split_sections(apply_page_edits(plain, edits)))
    return replace_documents(old, chunks) if old is not None else chunks


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
