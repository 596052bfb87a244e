"""Repeated passages (D1-D7): blocks of text that stand on several pages, and citations of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.operators.similarity import among, classes, similar_members
from docloom.sources.scratch import kept, once, packed

MIN_CHARS, CONTAINMENT, SIZE_RATIO, ANSWER_SHARE, PAGE_SIMILARITY = 120, 0.9, 0.6, 0.7, 0.9
ADDED_BY = "duplicate_passage"


def passages(blocks: DataFrame) -> DataFrame:
    """Blocks long enough to be passages: their columns and grams."""
    # lower case has at most three characters for one
    bare = once(blocks.filter(3 * F.length("text") >= MIN_CHARS), "_bare", t.without_references(F.col("text")))
    # of most blocks the beginning is long enough
    reach = lambda x: F.length(t.collapse(F.lower(x))) >= MIN_CHARS
    long = bare.filter(reach(F.substring("_bare", 1, MIN_CHARS + 20)) | reach(F.col("_bare")))
    return long.withColumn("grams", t.trigram_hashes(F.col("_bare"))).select(*blocks.columns, "grams")


def group_members(blocks: DataFrame) -> DataFrame:
    """(group, document_id, page, ordinal, text) of all blocks in groups on two pages or more."""
    # texts are read again for members of groups, not carried through the join
    rows = blocks.select("document_id", "page", "ordinal", "text").withColumn("row", F.xxhash64("document_id", "page", "ordinal", F.xxhash64("text")))
    found = classes(rows, passages, ["document_id", "page", "ordinal"], ["document_id", "page"], CONTAINMENT, SIZE_RATIO)
    place = F.struct("document_id", "page")
    wide = found.groupBy("group").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("group")
    members = packed(found.join(wide, "group"), "members")
    texts = among(rows.filter(3 * F.length("text") >= MIN_CHARS), "row", members.select("row").distinct()).select("row", "text").dropDuplicates(["row"])
    return members.join(texts, "row").select("group", "document_id", "page", "ordinal", "text")


def group_passages(blocks: DataFrame) -> DataFrame:
    """One row a group: n_pages, first (its earliest document_id and page) and the text there."""
    return groups_of(group_members(blocks))


def pages_of(members: DataFrame) -> DataFrame:
    """(group, document_id, page, text): one row a page of each group, with its first passage there."""
    return members.groupBy("group", "document_id", "page").agg(F.min_by("text", "ordinal").alias("text"))


def groups_of(members: DataFrame) -> DataFrame:
    place = F.struct("document_id", "page")
    return pages_of(members).groupBy("group").agg(F.count(F.lit(1)).alias("n_pages"), F.min(place).alias("first"), F.min_by("text", place).alias("text"))


def with_locations(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Groups with ``locations``, the sorted pages in one cell: for groups known to be small enough for one."""
    cells = pages_of(members).groupBy("group").agg(F.array_sort(F.collect_list(F.struct("document_id", "page"))).alias("locations"))
    return groups.join(cells, "group")


def used_groups(answers: DataFrame, groups: DataFrame, cites: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """(question_id, group): cited groups that a sentence of the answer is built on.

    answers(question_id, answer), groups(group, text); cites(question_id, document_id, page) with places(group, document_id, page):
    only groups at a cited place count; without them each group does. A sentence that shares so many words with a passage shares
    one of any few that are as many as it may lack and one more: those are looked up, the longest words, as they are the rarest ones.
    """
    parts = F.split(t.strip_citations(F.col("answer")), r"(?U)(?<=[.!?。])\s+|\n+")
    # content words are distinct; they are worked out once a sentence, not again for the filter
    words = once(answers.select("question_id", F.explode(parts).alias("s")), "words", t.content_words(F.col("s"))).select("question_id", "words").filter(F.size("words") >= 3)
    own = kept(groups.select("group", t.content_words(F.col("text")).alias("passage")))
    longest = F.sort_array(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))), asc=False)
    least = F.size("words") - F.ceil(F.round(F.size("words") * ANSWER_SHARE, 9)) + 1
    looked = words.withColumn("word", F.explode(F.slice(longest, F.lit(1), least.cast("int")))).withColumn("word", F.col("word.word"))
    met = looked.join(own.select("group", "passage", F.explode("passage").alias("word")), "word")
    found = met.filter(F.size(F.array_intersect("words", "passage")) / F.size("words") >= ANSWER_SHARE).select("question_id", "group").distinct()
    if cites is None:
        return found
    cited = cites.join(places.select("group", "document_id", "page"), ["document_id", "page"]).select("question_id", "group")
    return found.join(cited, ["question_id", "group"], "left_semi")


def expansion_locations(used: DataFrame, places: DataFrame, cites: DataFrame, variants: DataFrame, named: DataFrame) -> DataFrame:
    """(question_id, document_id, page, group): the other pages of used groups, one variant a document.

    places(group, document_id, page); variants(document_id, page, variant); named(question_id, document_id, variant): if a question names
    variants of a document only those count, else the variant of the group's first page there.
    """
    rows = used.join(places.select("group", "document_id", "page"), "group").join(variants, ["document_id", "page"], "left").withColumn("variant", F.coalesce("variant", F.lit("")))
    many = variants.groupBy("document_id").agg(F.count_distinct("variant").alias("_n")).filter("_n >= 2").select("document_id", F.lit(True).alias("_many"))
    asks = named.groupBy("question_id", "document_id").agg(F.collect_set("variant").alias("_asked"))
    rows = rows.join(many, "document_id", "left").join(asks, ["question_id", "document_id"], "left")
    first = F.min_by("variant", "page").over(W.partitionBy("question_id", "group", "document_id"))
    ok = F.col("_many").isNull() | F.when(F.col("_asked").isNotNull(), F.array_contains("_asked", F.col("variant"))).otherwise(F.col("variant") == first)
    rows = rows.withColumn("_ok", ok).filter("_ok").join(cites.select("question_id", "document_id", "page"), ["question_id", "document_id", "page"], "left_anti")
    return rows.groupBy("question_id", "document_id", "page").agg(F.min("group").alias("group"))


def with_duplicate_citations(evidence: DataFrame, locations: DataFrame, groups: DataFrame, metadata: DataFrame, short_ids: DataFrame) -> DataFrame:
    """Evidence with retrieved but uncited pages marked, and a unit appended for each other page.

    evidence(question_id, rank, evidence_id, context_id, document_id, page, text_unit_id, text, source_type,
    added_by); locations as D5 returns them; metadata(text_unit_id, document_id, page, text);
    short_ids(text_unit_id, context_id). Of a page's units the one with most words of the passage is taken.
    """
    key = ["question_id", "document_id", "page"]
    units = F.col("source_type") == "text_unit"
    want = locations.select(*key, F.lit(True).alias("_want"))
    marked = evidence.join(want, key, "left")
    nth = F.row_number().over(W.partitionBy(*key, F.col("_want").isNotNull() & units).orderBy("rank"))
    marked = marked.withColumn("added_by", F.when(F.col("_want") & units & (nth == 1), F.lit(ADDED_BY)).otherwise(F.col("added_by"))).select(*evidence.columns)
    rest = packed(locations.join(evidence.filter(units).select(*key), key, "left_anti"), "places")
    text = groups.select("group", t.content_words(F.col("text")).alias("_passage"))
    # texts of other pages are not shuffled
    place = F.xxhash64(F.col("document_id").cast("string"), F.col("page").cast("string")).alias("_at")
    asked = among(metadata.select("*", place), "_at", rest.select(place).distinct()).drop("_at")
    cells = rest.join(text, "group").join(asked, ["document_id", "page"]).withColumn("_same", F.size(F.array_intersect(F.array_distinct(t.content_words(F.col("text"))), "_passage")))
    best = cells.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("_same"), "text_unit_id"))).filter("_n = 1").join(short_ids, "text_unit_id", "left")
    size = evidence.groupBy("question_id").agg(F.max("rank").alias("_last"))
    rank = F.col("_last") + F.row_number().over(W.partitionBy("question_id").orderBy("document_id", "page"))
    new = best.join(size, "question_id").withColumn("rank", rank)
    cells = {"rank": F.col("rank").cast("int"), "evidence_id": F.concat(F.lit("E"), F.col("rank").cast("int")), "source_type": F.lit("text_unit"), "added_by": F.lit(ADDED_BY), "context_id": F.coalesce("context_id", F.lit(""))}
    return marked.unionByName(new.select(*[cells.get(c, F.col(c) if c in new.columns else F.lit(None)).alias(c) for c in evidence.columns]))


def page_equivalence(pages: DataFrame, least: float = PAGE_SIMILARITY) -> DataFrame:
    """(document_id, page, other): pages of one document with the same text; each page equals itself."""
    items = pages.select(F.col("document_id").alias("scope"), "page", t.trigram_hashes(t.without_references(F.col("text"))).alias("grams"))
    both = similar_members(items, least, "page").select(F.col("scope").alias("document_id"), "page", F.col("page_other").alias("other"))
    own = pages.select("document_id", "page", F.col("page").alias("other"))
    return both.unionByName(own).distinct()
