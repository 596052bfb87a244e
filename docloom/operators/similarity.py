"""Set-similarity self join with prefix filters, and the classes that its links form.

Sets are arrays of distinct 64-bit hashes, in one global order. Equal sets are
one row first, so copies of a passage never meet pairwise. Two sets can only reach the threshold
if they share an element of their prefixes, whatever the order is; candidates meet on that and are then verified.
The order is that of rising frequency, counted in BUCKETS of the hashes, so that only a table of a fixed
size is sent to the tasks, and prefixes are cut where the sets lie: no element beyond them is shuffled.

Classes take little disk beside their rows: sets are not kept, but cut again from their rows. A first pass finds
the rows of equal sets, a second one the sets of which others hold enough elements for any link, counted in cells of 32 bits
that are shuffled without their sets; only those few are cut a third time, and joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.components import components
from docloom.sources.scratch import kept, packed, tidy, workspace

BUCKETS, PART, SEND_IDS = 1 << 22, 1 << 14, 2_000_000
#: Elements that one task counts, least and most ranges of them; bits a key, least and most bits of a filter of keys, bits of a part of it.
COUNTED, RANGES, KEY_BITS, FILTER, FILTER_PART = 1 << 23, (4, 12), 4, (20, 28), 17


def _often(sets: DataFrame) -> np.ndarray:
    """How many elements of all sets(grams, scope) fall into each of BUCKETS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(_elements(batch.column(0), batch.column(1))[0] & (BUCKETS - 1), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS // PART)), pa.array([x.tobytes() for x in total.reshape(-1, PART)], pa.binary())], ["part", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in rows["counts"])
        return pa.table({"part": rows["part"][:1], "counts": pa.array([np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())})

    parts = sets.select("grams", "scope").mapInArrow(count, "part long, counts binary").groupBy("part").applyInArrow(add, "part long, counts binary").collect()
    return np.frombuffer(b"".join(bytes(r["counts"]) for r in sorted(parts, key=lambda r: r["part"])), np.uint32)


def _elements(grams: pa.ListArray, scope: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The elements of all sets, told apart by scope, their sets, and where each set begins."""
    at = np.asarray(grams.offsets).astype(np.int64)
    n = np.diff(at)
    return np.asarray(grams.values)[at[0] : at[-1]] ^ np.repeat(np.asarray(scope), n), np.repeat(np.arange(len(n)), n), at[:-1] - at[0]


def _index(sets: DataFrame, low: float) -> DataFrame:
    """(id, n, gram, rank): the first elements of sets(id, n, grams, scope) in the order of their buckets' counts, then of their hashes."""
    sent = sets.sparkSession.sparkContext.broadcast(_often(sets))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                x, row, begin = _elements(part.column(2), part.column(3))
                often = sent.value[x & (BUCKETS - 1)]
                order = np.lexsort((x, often, row))
                n = np.asarray(part.column(1)).astype(np.int64)
                rank = np.arange(len(x)) - begin[row] + 1
                # the only one of its bucket is in no other set
                ok = (rank <= (n - np.ceil(np.round(n * low, 9)).astype(np.int64) + 1)[row]) & (often[order] > 1)
                of = pa.array(row[ok])
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(x[order][ok]), pa.array(rank[ok].astype(np.int32))], ["id", "n", "gram", "rank"])

    schema = T.StructType([sets.schema["id"], T.StructField("n", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("rank", T.IntegerType())])
    return sets.select("id", "n", "grams", "scope").mapInArrow(first, schema)


def similar_sets(sets: DataFrame, share: float, ratio: float, by: str, kept: Callable[[DataFrame], DataFrame] = kept, new: Callable[[Column], Column] | None = None) -> DataFrame:
    """(a, b): linked ids of sets(id, grams), a <> b. by 'containment': |a & b| >= share * smaller and
    smaller >= ratio * larger; by 'jaccard': |a & b| >= share * |a | b|. An optional column ``scope``
    restricts links to sets of one scope; ``new`` leaves out those of two sets whose ids are not new ones."""
    scope = F.xxhash64("scope") if "scope" in sets.columns else F.lit(0).cast("long")
    sets = kept(sets.filter(F.size("grams") > 0).select("id", F.size("grams").alias("n"), "grams", scope.alias("scope")))
    prefix = lambda x: (F.col("n") - F.ceil(F.round(F.col("n") * x, 9)) + 1).cast("int")
    index = _index(sets, share * ratio if by == "containment" else share)
    index = kept(index.withColumn("new", new(F.col("id")) if new else F.lit(True)))
    probe = index.filter(F.col("rank") <= prefix(share))
    a = probe.select("gram", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("rank").alias("r_a"), F.col("new").alias("new_a"))
    b = index.select("gram", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("rank").alias("r_b"), F.col("new").alias("new_b"))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    # after the first common element no more can be shared than the shorter rest
    need = share * F.col("n_a") if by == "containment" else share / (1 + share) * (F.col("n_a") + F.col("n_b"))
    enough = 1 + F.least(F.col("n_a") - F.col("r_a"), F.col("n_b") - F.col("r_b")) >= need - 1e-6
    met = a.join(b, "gram").filter((F.col("new_a") | F.col("new_b")) & smaller & (F.col("n_a") >= ratio * F.col("n_b")) & enough).select("a", "b").distinct()
    met = kept(met)
    # only sets that met are shuffled with their elements
    ids = kept(met.select(F.explode(F.array("a", "b")).alias("_id")).distinct())
    asked = sets.join(F.broadcast(ids) if ids.count() <= SEND_IDS else ids, F.col("id") == F.col("_id"), "left_semi")
    left, right = (asked.select(F.col("id").alias(x), F.col("grams").alias(f"g_{x}"), F.col("scope").alias(f"s_{x}")) for x in "ab")
    same = F.size(F.array_intersect("g_a", "g_b"))
    whole = F.size("g_a") if by == "containment" else F.size("g_a") + F.size("g_b") - same
    return met.join(left, "a").join(right, "b").filter((F.col("s_a") == F.col("s_b")) & (same / whole >= share)).select("a", "b")


def similar_members(items: DataFrame, least: float, *names: str) -> DataFrame:
    """(scope, names of one, names of the other with ``_other`` after them): members of items(scope, names, grams) with equal or similar sets.

    Equal sets are one row while they are compared. Both directions, and each member with itself.
    """
    keyed = kept(items.filter(F.size("grams") > 0).withColumn("id", F.xxhash64("scope", F.array_sort("grams"))))
    sets = keyed.groupBy("id").agg(F.first("scope").alias("scope"), F.first("grams").alias("grams"))
    links = kept(similar_sets(sets, least, least, "jaccard"))
    own = keyed.select("id", "scope", *names)
    other = keyed.select(F.col("id").alias("_b"), *(F.col(c).alias(f"{c}_other") for c in names))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(keyed.select(F.col("id").alias("a"), F.col("id").alias("b")).distinct())
    return own.join(both, F.col("id") == F.col("a")).join(other, F.col("b") == F.col("_b")).select("scope", *names, *(f"{c}_other" for c in names))


def set_id(grams: str) -> Column:
    return F.xxhash64(F.array_sort(grams))


def one_of(keys: DataFrame) -> Callable[[Column], Column]:
    """Is a hash one of keys (one column)? True for few others too: a filter of a bounded size goes to the tasks."""
    bits = min(max(FILTER[0], keys.count().bit_length() + KEY_BITS), FILTER[1])
    mask, part = (1 << bits) - 1, (1 << FILTER_PART) - 1

    def pack(found: pa.Table) -> pa.Table:
        on = np.zeros(1 << FILTER_PART, bool)
        on[np.asarray(found["bit"].combine_chunks()) & part] = True
        return pa.table({"part": found["part"][:1], "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    bit = keys.select(F.col(keys.columns[0]).bitwiseAND(F.lit(mask)).alias("bit")).select(F.shiftright("bit", FILTER_PART).alias("part"), "bit")
    with tidy(keys.sparkSession):
        parts = bit.groupBy("part").applyInArrow(pack, "part long, bits binary").collect()
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts:
        whole[r["part"] << (FILTER_PART - 3) :][: 1 << (FILTER_PART - 3)] = np.frombuffer(r["bits"], np.uint8)
    sent = keys.sparkSession.sparkContext.broadcast(whole)

    @F.arrow_udf(T.BooleanType())
    def test(hashes: pa.Array) -> pa.Array:
        at = np.asarray(hashes) & mask
        return pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).cast(pa.bool_())

    return test


def among(rows: DataFrame, name: str, keys: DataFrame) -> DataFrame:
    """rows whose column (a hash) is one of keys (one column), and few others."""
    return rows.filter(one_of(keys)(F.col(name)))


def shared_enough(sets: DataFrame, elements: int, least: float) -> DataFrame:
    """(id): sets(id, grams, new) with as many elements in other sets as least of their size takes, and few more. For a set
    that is not new only new ones count as others. ``elements``: about how many there are.

    Sets are dealt in chunks: each range of elements gets the cells of a chunk and how many of them each set has, and gives back
    how many of these other sets have.
    """
    bits = min(max(RANGES[0], (elements // COUNTED).bit_length()), RANGES[1])
    small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()
    wide = lambda x, n: np.frombuffer(x, f"u{max(1, len(x) // n)}").astype(np.int64)
    schema = "part int, chunk long, n int, new boolean, ids binary, sizes binary, cells binary"

    def rows(of: list[tuple], names: str) -> dict:
        kinds = {"part": pa.int32(), "chunk": pa.int64(), "n": pa.int32(), "new": pa.bool_(), "ids": pa.binary(), "sizes": pa.binary(), "cells": pa.binary()}
        return {k: pa.array([r[i] for r in of], kinds[k]) for i, k in enumerate(names.split())}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the same numbers if the task runs again
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for new in (True, False):
                own = batch.filter(batch.column(2) if new else pc.invert(batch.column(2)))
                if not own.num_rows:
                    continue
                x, row, _ = _elements(own.column(1), np.zeros(own.num_rows, np.int64))
                x, n = x.view(np.uint64), own.num_rows
                part = (x >> np.uint64(64 - bits)).astype(np.uint16)
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange((1 << bits) + 1))
                cells, row = (x >> np.uint64(32 - bits)).astype(np.uint32)[order], row[order]
                out = [((1 << bits) + chunk % (1 << bits), chunk, n, new, np.asarray(own.column(0)).tobytes(), small(np.diff(np.asarray(own.column(1).offsets))), None)]
                for k in range(1 << bits):
                    at = slice(ends[k], ends[k + 1])
                    if ends[k] < ends[k + 1]:
                        out.append((k, chunk, n, new, None, small(np.bincount(row[at], minlength=n)), cells[at].tobytes()))
                yield pa.RecordBatch.from_pydict(rows(out, "part chunk n new ids sizes cells"))
                chunk += 1

    def count(found: pa.Table) -> pa.Table:
        found = found.combine_chunks()
        if found["ids"].null_count == 0:
            return found.select(["chunk", "n", "ids", "sizes"])
        chunks = [np.frombuffer(x.as_buffer(), np.uint32) for x in found["cells"]]
        ends = np.cumsum([0, *map(len, chunks)])
        cells = np.concatenate(chunks).astype(np.uint64) << np.uint64(32)
        cells |= np.arange(len(cells), dtype=np.uint64)
        cells.sort()
        at = (cells & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cells = (cells >> np.uint64(32)).astype(np.uint32)
        begin = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        size = np.diff(np.r_[begin, len(cells)])
        new = np.repeat(np.asarray(found["new"].combine_chunks().cast(pa.uint8()), bool), np.diff(ends))[at]
        fresh = np.add.reduceat(new, begin, dtype=np.int64)
        met = np.zeros(len(cells), bool)
        met[at] = np.where(new, np.repeat(size > 1, size), np.repeat(fresh > 0, size))
        out = []
        for k, (chunk, n, sizes) in enumerate(zip(found["chunk"].to_pylist(), found["n"].to_pylist(), found["sizes"].to_pylist())):
            of = np.repeat(np.arange(n), wide(sizes, n))
            out.append((chunk, n, None, small(np.bincount(of[met[ends[k] : ends[k + 1]]], minlength=n))))
        return pa.table(rows(out, "chunk n ids sizes"))

    def add(found: pa.Table) -> pa.Table:
        total = need = ids = 0
        for r in found.to_pylist():
            cells = wide(r["sizes"], r["n"])
            if r["ids"] is None:
                total = total + cells
            else:
                ids, need = np.frombuffer(r["ids"], np.int64), np.ceil(np.round(cells * least, 9))
        return pa.table({"id": pa.array(ids[total >= need])})

    dealt = sets.select("id", "grams", "new").mapInArrow(deal, schema)
    counted = dealt.groupBy("part").applyInArrow(count, "chunk long, n int, ids binary, sizes binary")
    return counted.groupBy("chunk").applyInArrow(add, "id long")


def links_of(rows: DataFrame, cut: Callable[[DataFrame], DataFrame], kinds: DataFrame, share: float, ratio: float, keep: Callable[[DataFrame, str], DataFrame], new: DataFrame | None = None) -> DataFrame:
    """(a, b): links by containment between the sets (row, id, grams) that cut() gives rows(row). kinds(id, row, n): a row and the
    size of each set. ``new``(id): only links with one of these."""
    elements = kinds.agg(F.sum("n")).first()[0] or 0
    fresh = one_of(new.select("id")) if new is not None else None
    # of equal sets one row's
    own = cut(among(rows, "row", kinds.select("row"))).select("id", "grams")
    near = keep(shared_enough(own.withColumn("new", fresh(F.col("id")) if fresh else F.lit(True)), elements, share * ratio), "near")
    own = cut(among(rows, "row", kinds.join(near, "id", "left_semi").select("row")))
    links = similar_sets(keep(own.groupBy("id").agg(F.first("grams").alias("grams")), "sets"), share, ratio, "containment", lambda df: keep(df, "join"), fresh)
    if new is None:
        return links
    links = keep(links, "links")
    ends = [links.join(new.select(F.col("id").alias(x)), x, "left_semi").select("a", "b") for x in "ab"]
    return ends[0].unionByName(ends[1]).distinct()


def classes(rows: DataFrame, cut: Callable[[DataFrame], DataFrame], names: list[str], place: list[str], share: float, ratio: float) -> DataFrame:
    """(row, names, group) of those of rows(row, names) that cut() gives a set (row, names, grams): linked by containment, directly or through others.

    ``row`` is a hash that tells rows apart, but those that are the same altogether. Sets of one ``place`` are not linked.
    """
    sets = lambda of: cut(of).filter(F.size("grams") > 0).withColumn("id", set_id("grams"))
    spark, at = rows.sparkSession, F.struct(*place)
    with workspace(spark, "classes") as keep, tidy(spark):
        keyed = keep(sets(rows).select("row", *names, "id", F.size("grams").alias("n")), "rows")
        kinds = keep(keyed.groupBy("id").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.min(at).alias("first"), F.max(at).alias("last")), "kinds")
        links = links_of(rows, sets, kinds, share, ratio, keep)
        a, b = (kinds.select("id", "first", "last").toDF(x, f"{x}_first", f"{x}_last") for x in "ab")
        apart = (F.col("a_first") != F.col("a_last")) | (F.col("b_first") != F.col("b_last")) | (F.col("a_first") != F.col("b_first"))
        live = keep(links.join(a, "a").join(b, "b").filter(apart).select("a", "b"), "links")
        found = components(kinds.select(F.col("id").alias("fp")), live).toDF("id", "group")
        return packed(keyed.join(found, "id").select("row", *names, "group"), "classes")
