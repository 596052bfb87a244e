"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

Targets: the sources share ``budget`` times all words by weight; a target stops at ``most`` times
its source's words and the excess is reshared by weight (water level, by sorting the sources).

Schedule: slot k maps the golden-ratio point frac((k + 1) / phi) through the cumulative target
shares to a source; the slots of a source are ranked, and slot r of a source takes the r-th block
of ``block`` words of its shuffled documents, which repeat from the start when used up. Slots
beyond a source's need are dropped; the few that low discrepancy leaves a source short follow at
the end; a source's last block is cut at its target.

Ranks and running sums are made in two levels (hash bucket, then within it), so no source, however
large, meets in one task. Rows with null source form the last source; repeated rows count each;
rows of 0 words are never taken. Words: runs of anything but \\x20 and \\x09-\\x0D; null text: 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import hash_share, kept, name_apart

BLOCK, PHI, SOURCES_TO_SEND = 256, 0.6180339887498949, 20_000


def word_count(text: Column) -> Column:
    cells = F.split(text, r"[\x20\x09-\x0D]+")
    edges = F.when(F.element_at(cells, 1) == "", 1).otherwise(0) + F.when((F.size(cells) > 1) & (F.element_at(cells, -1) == ""), 1).otherwise(0)
    return F.when(text.isNull(), 0).otherwise(F.size(cells) - edges).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source: source, nth, weight, n_docs, source_size, target, low, high (its share of [0, 1))."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # one row a source from here on: the table of sources, not the rows, is what these windows sort
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    nth = by.withColumn("nth", F.row_number().over(order) - 1)
    nth = nth.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int")))
    full = nth.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("total", F.sum("source_size").over(W.partitionBy()) * F.lit(budget))
    level = W.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    after = W.orderBy((F.col("cap") / F.col("weight")).desc(), F.col("nth").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = full.withColumn("before", F.sum("cap").over(level) - F.col("cap")).withColumn("rest", F.sum("weight").over(after))
    # the water level if this source and all that fill up later stay open; the first that holds is the level
    filled = filled.withColumn("water", (F.col("total") - F.col("before")) / F.col("rest"))
    filled = filled.withColumn("level", F.min(F.when(F.col("water") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "nth", "water"))).over(W.partitionBy())["water"])
    aimed = filled.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")))
    run = F.sum("target").over(W.orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow))
    whole = F.sum("target").over(W.partitionBy())
    return aimed.withColumn("high", F.when(whole > 0, run / whole).otherwise(0.0)).withColumn("low", F.when(whole > 0, (run - F.col("target")) / whole).otherwise(0.0)).select("source", "nth", "weight", "n_docs", "source_size", "target", "low", "high")


def _sent(df: DataFrame, n: int) -> DataFrame:
    """Broadcast a table of n rows if they are few; else it is joined as any other."""
    return F.broadcast(df) if n <= SOURCES_TO_SEND else df


def schedule(sources: DataFrame, n_sources: int, block: int = BLOCK) -> DataFrame:
    """(slot, nth, rank): which source's which block comes when."""
    spark = sources.sparkSession
    need = sources.select("nth", "low", "high", F.ceil(F.round("target") / block).alias("need"))
    slots = int(sources.agg(F.ceil(F.sum("target") / block)).first()[0] or 0)
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(PHI) - F.floor((F.col("id") + 1) * F.lit(PHI))).alias("u"))
    drawn = _banded(points, need, n_sources)
    drawn = drawn.select("slot", "nth", "need", F.expr("slot div 4096").alias("run"))
    runs = drawn.groupBy("nth", "run").agg(F.count(F.lit(1)).alias("n"))
    before = runs.select("nth", "run", (F.sum("n").over(W.partitionBy("nth").orderBy("run")) - F.col("n")).alias("before"))
    inside = drawn.withColumn("k", F.row_number().over(W.partitionBy("nth", "run").orderBy("slot")))
    ranked = inside.join(before, ["nth", "run"]).select("slot", "nth", (F.col("before") + F.col("k") - 1).alias("rank"), "need").filter("rank < need").drop("need")
    have = runs.groupBy("nth").agg(F.sum("n").alias("have"))
    short = need.join(have, "nth", "left").select("nth", "need", F.coalesce("have", F.lit(0)).alias("have")).filter("have < need")
    late = short.select("nth", F.explode(F.sequence("have", F.col("need") - 1)).alias("rank")).select((F.lit(slots) + F.col("rank")).alias("slot"), "nth", "rank")
    return ranked.unionByName(late)


def _banded(points: DataFrame, need: DataFrame, n_sources: int) -> DataFrame:
    """Points and shares meet in cells of [0, 1), of which a share spans few on average."""
    cells = 4 * n_sources + 1000
    left = points.withColumn("cell", F.floor(F.col("u") * cells))
    right = need.filter("low < high").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.col("high") * cells))))
    return left.join(_sent(right, n_sources), "cell").filter((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).drop("cell")


def mixed(docs: DataFrame, seed: int = 11, block: int = BLOCK, keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """One row for each row of docs: ``keep``, source, size, source_size, target, taken."""
    sizes = kept(docs.select(*keep, "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")))
    sources = kept(targets(sizes, **options))
    n_sources = sources.count()
    joined = sizes.join(_sent(sources.withColumnRenamed("source", "_source"), n_sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # shuffled order: by hash; buckets of about 1,000 rows, each within one source
    drawn = joined.withColumn("h", hash_share(F.lit(seed), *keep, "text_hash"))
    drawn = drawn.withColumn("bucket", F.floor(F.col("h") * F.ceil(F.col("n_docs") / 1000) / F.lit(1 << 31)))
    sums = drawn.groupBy("nth", "bucket").agg(F.sum("size").alias("n"))
    base = sums.select("nth", "bucket", (F.sum("n").over(W.partitionBy("nth").orderBy("bucket")) - F.col("n")).alias("base"))
    order = W.partitionBy("nth", "bucket").orderBy("h", *keep, "text_hash", "size")
    inside = drawn.withColumn("row", F.row_number().over(order)).withColumn("run", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size"))
    placed = inside.join(base, ["nth", "bucket"]).withColumn("start", F.col("base") + F.col("run"))
    # the source's line of words, gone through twice, cut into blocks up to its target
    line = F.explode(F.array(F.lit(0), F.lit(1))).alias("pass")
    aim = F.round("target").cast("long")
    passes = placed.filter("size > 0").select("nth", "bucket", "row", "size", (F.col("start")).alias("at"), "source_size", aim.alias("aim"), line)
    passes = passes.withColumn("a", F.col("at") + F.col("pass") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("aim"))).filter("a < b")
    pieces = passes.withColumn("rank", F.explode(F.sequence(F.expr(f"a div {block}"), F.expr(f"(b - 1) div {block}"))))
    words = F.least("b", (F.col("rank") + 1) * block) - F.greatest("a", F.col("rank") * block)
    slots = schedule(sources, n_sources, block)
    taken = pieces.withColumn("words", words).join(slots, ["nth", "rank"]).groupBy("nth", "bucket", "row").agg(F.sum("words").alias("words"))
    out = placed.join(taken, ["nth", "bucket", "row"], "left")
    return out.select(*keep, "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "text_hash")


def applied(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: each row as often as its taken words round to its size (0 to 2 times)."""
    k1, k2, n, copies, copy = name_apart(docs, "k1", "k2", "n", "copies", "copy")
    cells = [x for c in docs.columns for x in (F.col(c), F.col(c).isNull())]
    marked = docs.withColumn(k1, F.xxhash64(*cells)).withColumn(k2, F.xxhash64(F.lit(1), *cells))
    mix = mixed(marked, keep=(k1, k2), **options)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    total = mix.groupBy(k1, k2).agg(F.sum(times).cast("int").alias(copies), F.count(F.lit(1)).alias(n)).filter(F.col(copies) > 0)
    joined = marked.join(total, [k1, k2])
    # repeated rows are alike in all columns: their copies add up on one of them
    one = joined.filter(F.col(n) == 1).unionByName(joined.filter(F.col(n) > 1).dropDuplicates([k1, k2]))
    return one.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
