"""Sharding by minimax contiguous partition, in DataFrame operations.

Rows of equal texts form an atomic group. Groups are ordered by a hash of the text and cut into at
most ``shards`` runs so that the largest run's bytes are as small as possible: the smallest
capacity for which filling shard after shard greedily needs no more than that many is found by
binary search, and the order is cut there.

The search needs the groups' sizes only near the possible cuts. Sums over hash ranges come to the
driver (2^10 ranges at first); bounds of the capacity from them show between which ranges a cut may
lie, and only those are split further, by 6 bits a round, until each holds one group. What the
driver holds is bounded by shards and ranges, not by the rows. A hash of 60 bits orders the groups;
groups that share one (two in 10^9 with probability 0.5) are kept together.

Slots number a shard's rows from 0 without gaps, in two levels (hash bucket, then within it).
Null texts are a group of their own of 1 byte a row. Repeated rows each take a slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import hash_share, kept

BITS, FIRST, MORE = 60, 10, 6


def text_order(text: Column) -> Column:
    """60 bits of the text's MD5 as a number; null texts: the largest."""
    return F.coalesce(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit((1 << BITS) - 1))


def _greedy(sizes: list[int], capacity: int) -> list[int]:
    """Positions after which shards are cut, if each takes as much as fits."""
    cuts, used = [], 0
    for i, s in enumerate(sizes):
        if used and used + s > capacity:
            cuts.append(i)
            used = 0
        used += s
    return cuts


def _smallest(sizes: list[int], shards: int) -> int:
    """The smallest capacity that needs at most so many shards."""
    low, high = max([0, *sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if len(_greedy(sizes, mid)) < shards:
            high = mid
        else:
            low = mid + 1
    return low


def cuts(groups: DataFrame, shards: int) -> list[int]:
    """Orders before which a new shard starts. groups: (order, size), one row a group or part of one."""
    one = groups.groupBy("order").agg(F.sum("size").alias("size"))
    one = kept(one)

    def sums(bits: int, above: int = 0, parents: list[int] | None = None) -> list:
        rows, shift = one, BITS - bits
        if parents is not None:
            rows = rows.filter(F.shiftright("order", BITS - above).isin(parents))
        got = rows.groupBy(F.shiftright("order", shift).alias("range")).agg(F.sum("size").alias("size"), F.max("size").alias("most"), F.count(F.lit(1)).alias("n"), F.min("order").alias("least"))
        return [(r["range"] << shift, r["size"], r["most"], r["n"], r["least"]) for r in got.collect()]

    bits = FIRST
    ranges = sorted(sums(bits))
    while ranges:
        sizes = [r[1] for r in ranges]
        total, most = sum(sizes), max(r[2] for r in ranges)
        low, high = max(most, -(-total // shards)), _smallest(sizes, shards)
        # with capacity low and ranges as they are, greedy comes no farther than the true cut;
        # a cut lies no farther than if sizes could be divided freely at capacity high
        edges, open_ = [0], set()
        for s in sizes:
            edges.append(edges[-1] + s)
        early = [edges[c] for c in _greedy(sizes, max(low, 1))]
        if max(sizes) > low:  # a range that no shard can take whole: each shard still takes more than low - most
            early = [min(total, k * (low - most)) for k in range(1, shards)]
        for k in range(1, shards):
            first, last = (early[k - 1] if k <= len(early) else total), k * high
            open_ |= {i for i in range(len(ranges)) if ranges[i][3] > 1 and edges[i] <= last and edges[i + 1] >= min(first, last)}
        if not open_ or bits >= BITS:
            return [ranges[c][4] for c in _greedy(sizes, _smallest(sizes, shards))]
        # ranges differ in depth: only those of the present depth can still hold several groups
        parents = sorted({ranges[i][0] >> (BITS - bits) for i in open_})
        deeper = min(BITS, bits + MORE)
        finer = sums(deeper, bits, parents)
        ranges = sorted([r for i, r in enumerate(ranges) if i not in open_] + finer)
        bits = deeper
    return []


def sharded(docs: DataFrame, shards: int = 8, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of docs: ``keep``, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.col("text")
    slim = docs.select(*keep, (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), text_order(text).alias("order"))
    rows = kept(slim)
    at = cuts(rows.select("order", "size"), shards)
    shard = sum([(F.col("order") >= c).cast("int") for c in at], F.lit(0))
    placed = rows.withColumn("shard", shard).withColumn("h", hash_share(*keep, "text_crc32"))
    n = rows.count()
    placed = placed.withColumn("bucket", F.floor(F.col("h") * max(1, n // (1000 * shards)) / F.lit(1 << 31)))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = placed.withColumn("k", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("h", *keep, "text_crc32", "size")))
    out = inside.join(before, ["shard", "bucket"])
    return out.select(*keep, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
