"""Variants of a manual (V1-V9): chapters that repeat for other equipment, tagged in page headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.operators.greedy import excluded
from docloom.operators.ordering import carried, placed, with_neighbours
from docloom.operators.similarity import similar_members
from docloom.sources.scratch import written

# ---- fixed values ----
TAG_LINE = r"^\[([A-Z0-9][A-Z0-9 &/+.\-]{0,46})\]$"
CHAPTER_LINE = r"(?U)^<\s*(.+?)\s*>$"
FAMILY = r"(?U)\s+(?:WITH|WITHOUT)\s+"
ALIASES = {"導航": "navigation", "导航": "navigation"}
SIMILARITY = 0.9
# ---- end of fixed values ----


def header_tags(headers: DataFrame) -> DataFrame:
    """V1: (document_id, page, variant, chapter): the first tag line and the first chapter line of each header."""
    lines = F.transform(t.lines_of(F.coalesce("text", F.lit(""))), t.collapse)
    first = lambda pattern: F.coalesce(F.regexp_extract(F.get(F.filter(lines, lambda v: v.rlike(pattern)), F.lit(0)), pattern, 1), F.lit(""))
    return headers.select("document_id", "page", first(TAG_LINE).alias("variant"), first(CHAPTER_LINE).alias("chapter"))


def assign_variants(tags: DataFrame) -> DataFrame:
    """V2: an untagged page has the tag of the page before while the chapter stays the same; tags carry on over ranges of pages."""
    by, order = ["document_id"], ["page"]
    met = with_neighbours(placed(tags, by, order), by, order, ["chapter"])
    starts = (F.col("variant") != "") | (F.col("chapter") == "") | ~F.col("chapter").eqNullSafe(F.col("_before.chapter"))
    rows = carried(met.withColumn("_tag", F.when(starts, F.col("variant"))), by, order, "_tag", "_carried", own=True)
    return rows.withColumn("variant", F.col("_carried")).select(*tags.columns)


def variant_catalog(headers: DataFrame, stamps: DataFrame | None = None, old: DataFrame | None = None) -> DataFrame:
    """V3: (document_id, page, variant[, stamp]) of tagged pages; documents with an unchanged stamp keep the old rows."""
    if stamps is None:
        return assign_variants(header_tags(headers)).filter("variant <> ''").select("document_id", "page", "variant")
    same = old.select("document_id", "stamp").distinct().join(stamps, ["document_id", "stamp"], "left_semi")
    fresh = headers.join(same, "document_id", "left_anti").join(stamps.select("document_id"), "document_id", "left_semi")
    new = variant_catalog(fresh).join(stamps, "document_id")
    return old.join(same, ["document_id", "stamp"], "left_semi").select("document_id", "page", "variant", "stamp").unionByName(new.select("document_id", "page", "variant", "stamp"))


def multi_variant(catalog: DataFrame) -> DataFrame:
    """V3: documents with two different tags or more."""
    return catalog.groupBy("document_id").agg(F.count_distinct("variant").alias("n")).filter("n >= 2").select("document_id")


def _name(text):
    return t.collapse(F.regexp_replace(F.lower(text), "[^0-9a-z㐀-鿿]+", " "))


def question_variants(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """V4: (question_id, document_id, variant) that a question names: full names, else families before WITH / WITHOUT."""
    text = F.col("question")
    for alias, word in ALIASES.items():
        text = F.replace(text, F.lit(alias), F.lit(f" {word} "))
    asked = questions.select("question_id", F.concat(F.lit(" "), _name(text), F.lit(" ")).alias("_q"))
    tags = catalog.join(multi_variant(catalog), "document_id", "left_semi").select("document_id", "variant").distinct()
    family = F.when(F.col("variant").rlike(FAMILY), F.get(F.split("variant", FAMILY, 2), F.lit(0)))
    tags = tags.select("document_id", "variant", _name(F.col("variant")).alias("_full"), _name(family).alias("_family"))
    # tags are a table of names, not of pages: a phrase is looked up by its first word
    word = F.explode(F.array_distinct(F.filter(F.split("_q", " "), lambda w: w != ""))).alias("_w")
    names = tags.select("*", F.explode(F.array_distinct(F.array_compact(F.array(F.split_part("_full", F.lit(" "), F.lit(1)), F.split_part("_family", F.lit(" "), F.lit(1)))))).alias("_w"))
    met = asked.select("question_id", "_q", word).join(names, "_w")
    has = lambda c: F.coalesce((F.col(c) != "") & F.contains("_q", F.concat(F.lit(" "), F.col(c), F.lit(" "))), F.lit(False))
    rows = met.select("question_id", "document_id", "variant", has("_full").alias("_a"), has("_family").alias("_b")).filter("_a or _b").distinct()
    full = F.max("_a").over(W.partitionBy("question_id", "document_id"))
    return rows.withColumn("_any", full).filter(F.col("_a") | ~F.col("_any")).select("question_id", "document_id", "variant").distinct()


def select_sources(sources: DataFrame, questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """V5: sources(query_id, ordinal, key, document_id, page, variant, text, compare_text) with ``reason``: null if kept.

    First, sources of variants that the question does not name, if one that it names was retrieved; then,
    in page order, a later source of another variant with the text of a kept earlier one.
    """
    named = question_variants(questions.select(F.col("query_id").alias("question_id"), "question"), catalog).toDF("query_id", "document_id", "_named")
    sets = named.groupBy("query_id", "document_id").agg(F.array_sort(F.collect_set("_named")).alias("_named"))
    text = F.when(F.coalesce("compare_text", F.lit("")) != "", F.col("compare_text")).otherwise(F.col("text"))
    told = sources.withColumn("_text", F.xxhash64(text, "variant"))
    rows = told.join(sets, ["query_id", "document_id"], "left")
    tagged = F.coalesce(F.col("variant"), F.lit("")) != ""
    hit = F.max(tagged & F.array_contains("_named", F.col("variant"))).over(W.partitionBy("query_id", "document_id"))
    other = tagged & F.coalesce(hit, F.lit(False)) & ~F.array_contains("_named", F.col("variant"))
    rows = rows.withColumn("reason", F.when(other, F.concat(F.lit("question names "), F.array_join("_named", ", ")))).drop("_named")
    many = multi_variant(catalog).withColumn("_many", F.lit(True))
    rows = rows.join(many, "document_id", "left")
    live = rows.filter(F.col("reason").isNull() & F.col("_many") & tagged).select("query_id", "key", "document_id", "page", "variant", "ordinal", "_text")
    # a text that many queries retrieve is cut into triples once
    texts = told.filter(tagged).join(many, "document_id", "left_semi").select("_text", text.alias("text"), "variant").dropDuplicates(["_text"])
    cut = texts.withColumn("g", t.trigram_hashes(t.without_references(F.col("text"), F.col("variant")))).filter(F.size("g") > 0)
    cut = written(cut.select("_text", F.xxhash64(F.array_sort("g")).alias("set"), F.size("g").alias("n"), "g"), "texts")
    # sources of a query, document and variant with one set of words share their fate: each is excluded by what excludes the first
    at = F.struct(F.coalesce("page", F.lit(10**9)).alias("p"), "ordinal", "key")
    scope = ["query_id", "document_id"]
    live = written(live.join(cut.select("_text", "set", "n"), "_text").withColumn("at", at).drop("_text"), "candidates")
    classes = live.groupBy(*scope, "variant", "set").agg(F.min("at").alias("at"), F.min_by("page", "at").alias("page"), F.first("n").alias("n"))
    whole = F.struct(*scope, "at", "variant", "set", "page")
    first, later = (classes.select(*scope, F.col("set").alias(x), F.col("n").alias(f"n_{x}"), whole.alias(name)) for x, name in (("x", "first"), ("y", "later")))
    # what one query retrieves from one document meets; two texts are compared once, however many queries retrieve both
    sizes = (F.col("n_x") >= SIMILARITY * F.col("n_y") - 1e-6) & (F.col("n_y") >= SIMILARITY * F.col("n_x") - 1e-6)
    met = first.join(later, scope).filter(sizes & (F.col("first.variant") != F.col("later.variant")) & (F.col("first.at") < F.col("later.at")))
    met = written(met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "first", "later"), "met")
    pairs, sets = met.filter("x <> y").select("x", "y").distinct(), cut.groupBy("set").agg(F.first("g").alias("g"))
    both = pairs.join(sets.select(F.col("set").alias("x"), F.col("g").alias("g_x")), "x").join(sets.select(F.col("set").alias("y"), F.col("g").alias("g_y")), "y")
    same = F.size(F.array_intersect("g_x", "g_y"))
    near = both.filter(same / (F.size("g_x") + F.size("g_y") - same) >= SIMILARITY).select("x", "y")
    met = met.filter("x = y").unionByName(met.join(near, ["x", "y"], "left_semi"))
    done = excluded(met).select("row.query_id", "row.document_id", "row.variant", "row.set", F.col("by.page").alias("by_page"), F.col("by.variant").alias("by_variant"))
    why = F.concat(F.lit("same passage as "), F.col("document_id"), F.lit(" p."), F.coalesce(F.col("by_page").cast("string"), F.lit("None")), F.lit(" ["), F.col("by_variant"), F.lit("]"))
    drops = live.join(done, [*scope, "variant", "set"]).select("query_id", "key", why.alias("_why")).dropDuplicates(["query_id", "key"])
    return rows.join(drops, ["query_id", "key"], "left").withColumn("reason", F.coalesce("reason", "_why")).select(*sources.columns, "reason")


def earliest_equivalent_pages(sources: DataFrame, catalog: DataFrame, bodies: DataFrame, named: DataFrame) -> DataFrame:
    """V6: (query_id, key, earlier_page): the first earlier page of another (allowed) variant with the same text."""
    pages = catalog.join(multi_variant(catalog), "document_id", "left_semi").join(bodies, ["document_id", "page"], "left")
    grams = t.trigram_hashes(t.without_references(F.coalesce("text", F.lit("")), F.col("variant")))
    both = similar_members(pages.select(F.col("document_id").alias("scope"), "page", grams.alias("grams")), SIMILARITY, "page")
    pair = both.filter("page_other < page").select(F.col("scope").alias("document_id"), "page", F.col("page_other").alias("earlier_page")).distinct()
    tag = catalog.select("document_id", F.col("page").alias("earlier_page"), F.col("variant").alias("_other"))
    asks = named.groupBy(F.col("question_id").alias("query_id"), "document_id").agg(F.collect_set("variant").alias("_asked"))
    met = sources.filter(F.coalesce("variant", F.lit("")) != "").select("query_id", "key", "document_id", "page", "variant").join(pair, ["document_id", "page"]).join(tag, ["document_id", "earlier_page"]).join(asks, ["query_id", "document_id"], "left")
    ok = (F.col("_other") != F.col("variant")) & (F.col("_asked").isNull() | F.array_contains("_asked", F.col("_other")))
    return met.filter(ok).groupBy("query_id", "key").agg(F.min("earlier_page").alias("earlier_page"))


def replace_with_earliest(sources: DataFrame, earlier: DataFrame, units: DataFrame) -> DataFrame:
    """V7: such sources swapped for all units(key, document_id, page, text) of the earlier page; first of each key stays.

    Returns (query_id, ordinal, key, document_id, page, text, replaced_key).
    """
    rows = sources.join(earlier, ["query_id", "key"], "left")
    u = units.select(F.col("key").alias("_key"), F.col("document_id").alias("_doc"), F.col("page").alias("_page"), F.col("text").alias("_text"))
    met = rows.join(u, (F.col("document_id") == F.col("_doc")) & (F.col("earlier_page") == F.col("_page")), "left")
    out = met.select("query_id", "ordinal", F.coalesce("_key", "key").alias("key"), "document_id", F.coalesce("_page", "page").alias("page"), F.coalesce("_text", "text").alias("text"), F.when(F.col("_key").isNotNull(), F.col("key")).alias("replaced_key"))
    nth = F.row_number().over(W.partitionBy("query_id", "key").orderBy("ordinal", F.col("replaced_key").isNotNull()))
    out = out.withColumn("_n", nth).filter("_n = 1").drop("_n")
    return out.withColumn("ordinal", F.row_number().over(W.partitionBy("query_id").orderBy("ordinal", "key")))


def select_context(sources: DataFrame, questions: DataFrame, catalog: DataFrame, bodies: DataFrame, units: DataFrame) -> DataFrame:
    """V8: the whole pass over retrieved sources: select, replace, show the variant before the text."""
    kept = select_sources(sources, questions, catalog).filter(F.col("reason").isNull()).drop("reason")
    named = question_variants(questions.select(F.col("query_id").alias("question_id"), "question"), catalog)
    swapped = replace_with_earliest(kept, earliest_equivalent_pages(kept, catalog, bodies, named), units)
    tagged = swapped.join(catalog, ["document_id", "page"], "left")
    return tagged.withColumn("text", t.with_variant_prefix(F.col("text"), F.col("variant"))).select("query_id", "ordinal", "key", "document_id", "page", "variant", "text", "replaced_key")
