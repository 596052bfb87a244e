"""SimHash near-dedup: 64-bit fingerprints linked within a Hamming distance by general pigeonhole.

Bits are grouped by correlation into partitions. A pair within ``distance`` differs, in at least
one partition i, by at most t_i bits whenever the t_i sum to distance - partitions + 1 (t_i = -1:
not probed). The t_i, and the number of partitions, minimise the estimated probes and candidates
(dynamic programming over the distances' probabilities, from counts over all fingerprints). One
side of the join emits its value in each probed partition, the other all values within t_i; a
pair's full distance is verified in the join's condition, so no unverified pair leaves it.

Equal fingerprints are one row first. Near ones are first contracted along sorted orders, so that
a large group of near copies is one component before the join, which then only looks for pairs in
different components; components, not pairs, are the result.

Where links are also verified by Jaccard similarity, texts come first through an exact filter: who
has too few shingles that stand in another text as well is in no pair. Of the others each meets, in
every partition, the text whose shingles stand in most texts among those of its value (the middle of a
cloud of near copies). Then texts of different components meet by their rarest shingles: of two alike
sets these prefixes share one, in any order that holds for all, so no pair is lost, a text's rows follow
its own size, however many texts there are, and shingles within one component alone leave before the join.
The distance of the fingerprints stays a condition of that join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import kept, name_apart, ngrams, text_slices, word_hashes, written
from docloom.operators.components import components

#: Ids that are sent to all tasks, and parts of the rows that meet one leading text.
SEND_IDS, SALTS = 200_000, 8
#: Cells in which shingles are counted for the order of prefixes, and those that a row of the counts holds.
CELLS, PART = 1 << 20, 1 << 14


def fingerprint(text: str | None, width: int = 4) -> int:
    """Bit b is set if over half of the shingles' hashes have it; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only, and \x20 \x09-\x0d
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - width + 1)
    hashes = [xxhash.xxh64_intdigest(joined[i:j], 42) for i, j in zip(starts[:k].tolist(), ends[len(words) - k :].tolist(), strict=True)]
    raw, total = np.array(hashes, np.uint64), np.zeros(64, np.int64)
    for i in range(0, k, 1 << 16):
        total += np.unpackbits(raw[i : i + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(((total * 2 > k).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def with_fingerprint(docs: DataFrame, columns: list[str], out: str, width: int = 4) -> DataFrame:
    """The given columns and the text's fingerprint as a signed 64-bit integer. Columns may have any names but ``out``."""
    # texts that are given back go to the tasks once
    at = columns.index("text") if "text" in columns else len(columns)
    source = docs.select(*columns, *([] if "text" in columns else [F.col("text").alias(name_apart(docs, "_print_text")[0])]))
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField(out, T.LongType())])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = np.array([fingerprint(x.as_py(), width) for x in part.column(at)], np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(found.view(np.int64))], [*columns, out])

    return source.mapInArrow(prints, schema)


def _bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each two bits, of those with both: 64 x 64 counts over all rows."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64), np.float64), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 15):
                raw = np.asarray(batch.column(0).slice(i, 1 << 15)).view(np.uint64)
                bits = ((raw[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                total += bits.T @ bits
                n += len(raw)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(65 * 64) // 64), pa.array(np.arange(65 * 64) % 64), pa.array(np.concatenate([total.ravel(), np.full(64, n)]).astype(np.int64))], ["a", "b", "n"])

    rows = prints.select("fp").mapInArrow(counts, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    found = np.zeros((65, 64))
    for r in rows:
        found[r["a"], r["b"]] = r["n"]
    return int(found[64, 0]), found[:64]


def _grouped(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in partitions of almost equal size: each starts with a free bit and takes those that correlate most."""
    p = np.diag(both) / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(sd, sd))
    free, out = set(range(64)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [min(free, key=lambda b: (abs(p[b] - 0.5), b))]
        free.discard(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def _within(p: np.ndarray, group: list[int], most: int) -> np.ndarray:
    """Probability that two fingerprints differ by at most 0, 1, .. most bits of the group."""
    poly = np.zeros(most + 1)
    poly[0] = 1
    for b in group:
        d = 2 * p[b] * (1 - p[b])
        poly = poly * (1 - d) + np.concatenate([[0], poly[:-1]]) * d
    return np.cumsum(poly)


def plan(n: int, both: np.ndarray, distance: int, probe_cost: float = 200.0) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of least estimated cost: candidate pairs plus ``probe_cost`` for each emitted probe."""
    p, best = np.diag(both) / max(1, n), None
    for parts in range(max(1, (distance + 2) // 3), distance + 2):
        groups, budget = _grouped(n, both, parts), distance - parts + 1
        # cost[s]: least cost so far with thresholds that sum to s (shifted by the -1 that each may have)
        cost: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            reach = _within(p, group, max(0, budget + parts))
            nxt: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in cost.items():
                for t in range(-1, min(len(group), budget + parts) + 1):
                    probes = sum(float(_choose(len(group), k)) for k in range(t + 1))
                    if probes > 3000:
                        break
                    more = 0.0 if t < 0 else n * (n * reach[t] + probe_cost * (1 + probes))
                    if s + t not in nxt or c + more < nxt[s + t][0]:
                        nxt[s + t] = (c + more, [*ts, t])
            cost = nxt
        if budget in cost and (best is None or cost[budget][0] < best[0]):
            best = (cost[budget][0], list(zip(groups, cost[budget][1], strict=True)))
    return best[1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _masks(group: list[int], most: int) -> list[int]:
    out = []
    for k in range(most + 1):
        for bits in combinations(group, k):
            out.append(_signed(sum(1 << b for b in bits)))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _probes(rows: DataFrame, probed: list[tuple[int, list[int], int]]) -> DataFrame:
    """rows(fp and, if any, component, id, w) with (k, v) for each probed partition k: all values within its threshold of the own one."""
    names = [c for c in ("fp", "component", "id", "w") if c in rows.columns]
    table = [(k, np.int64(_signed(sum(1 << b for b in group))), np.array(_masks(group, t), np.int64)) for k, group, t in probed]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                own = [np.asarray(c.slice(i, 2000)) for c in batch.columns]
                for k, base, masks in table:
                    v = ((own[0] & base)[:, None] ^ masks).ravel()
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(x, len(masks))) for x in own), pa.array(np.full(len(v), k)), pa.array(v)], [*names, "k", "v"])

    return rows.select(*names).mapInArrow(emit, ", ".join(f"{c} long" for c in [*names, "k", "v"]))


def _chained(prints: DataFrame, groups: list[list[int]], distance: int) -> DataFrame:
    """Links of rows next to each other in sorted orders that begin with each partition's bits."""
    out, names = None, [c for c in ("fp", "id") if c in prints.columns]
    for group in groups:
        mask = _signed(sum(1 << b for b in group))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before = [np.zeros(0, np.int64)] * len(names)
            for batch in batches:
                own = [np.concatenate([x, np.asarray(c)]) for x, c in zip(before, batch.columns, strict=True)]
                raw, ids = own[0], own[-1]
                for gap in (1, 2):
                    if len(raw) > gap:
                        ok = np.bitwise_count((raw[:-gap] ^ raw[gap:]).view(np.uint64)) <= distance
                        yield pa.RecordBatch.from_arrays([pa.array(ids[:-gap][ok]), pa.array(ids[gap:][ok])], ["a", "b"])
                before = [x[-2:] for x in own]

        order = [F.col("fp").bitwiseAND(F.lit(mask)), *names]
        sort = prints.select(*names).repartitionByRange(*order).sortWithinPartitions(*order)
        links = sort.mapInArrow(near, "a long, b long")
        out = links if out is None else out.unionByName(links)
    return out


def _led(prints: DataFrame, probed: list[tuple[int, list[int], int]], distance: int) -> DataFrame:
    """(a, b): each of prints(fp, id, w) and, of those with its value in a partition, the one of the largest w."""
    rows = _probes(prints, [(k, g, 0) for k, g, _ in probed]).withColumn("salt", F.pmod(F.col("id"), F.lit(SALTS)).cast("int"))
    first = rows.groupBy("k", "v").agg(F.max(F.struct("w", "fp", "id")).alias("of"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    # one value may be that of many rows
    first = first.select("k", "v", F.col("of.fp").alias("of_fp"), F.col("of.id").alias("of_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    near = rows.join(first, ["k", "v", "salt"]).filter((F.col("id") != F.col("of_id")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("of_fp"))) <= distance))
    return near.select(F.col("id").alias("a"), F.col("of_id").alias("b"))


def linked(prints: DataFrame, distance: int = 4, verify: Callable[[DataFrame], DataFrame] | None = None, meet: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(fp, component): the distinct fingerprints of column ``fp``; component is the smallest one of the class.

    With a column ``id``, the distinct (id, fp) are what is linked, also those of one fingerprint:
    (id, component). ``verify`` takes pairs (a, b) of ids, or fingerprints, and returns those that
    are links. With ids there are also the set's size ``n`` and how many of it others have, ``m``, and
    ``meet`` takes (id, fp, component, n, m) and returns the pairs of different components to verify.
    """
    verify = verify or (lambda pairs: pairs)
    own = "id" if "id" in prints.columns else "fp"
    prints = kept(prints.select(*dict.fromkeys([own, "fp"]), *(["n", "m", "w"] if own == "id" else [])).distinct())
    names = prints.select(F.col(own).alias("fp"))
    n, both = _bit_counts(prints)
    if n < 2:
        return names.select(F.col("fp").alias(own), F.col("fp").alias("component"))
    chosen = plan(n, both, distance)
    probed = [(k, g, t) for k, (g, t) in enumerate(chosen) if t >= 0]
    start = _chained(prints, [g for g, _ in chosen], distance)
    if own == "id":
        start = start.unionByName(_led(prints, probed, distance)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = components(names, verify(start.distinct())).toDF(own, "component")
    links = first.select(F.col(own).alias("a"), F.col("component").alias("b"))
    if own == "id":
        found = meet(first.join(prints, "id").select("id", "fp", "component", "n", "m"))
    else:
        # one side has its own value in each partition, the other all values within the threshold
        a, b = _probes(first, probed), _probes(first, [(k, g, 0) for k, g, _ in probed])
        a, b = (x.select(*(F.col(c).alias(f"{c}_{side}") for c in x.columns)) for x, side in ((a, "a"), (b, "b")))
        # a pair is met from both sides, as the wide side has any value within t of its own; one is enough
        near = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= distance
        found = a.join(b, (a.k_a == b.k_b) & (a.v_a == b.v_b) & (F.col("component_a") < F.col("component_b")) & near).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    pairs = verify(found.distinct())
    return components(names, pairs.unionByName(links)).toDF(own, "component")


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of docs.

    component_id is the smallest doc_id of the class; null only if the class has null doc_ids alone.
    Null and empty texts have fingerprint 0, which links like any other.
    """
    prints = kept(with_fingerprint(docs, ["doc_id"], "fp", width))
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = linked(groups, distance)
    ids = groups.join(classes, "fp").select("fp", "component", "least")
    heads = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    named = ids.join(heads, "component").select("fp", "component_id")
    # a fingerprint of many copies is one row of the right side; the left side's hot key may be split
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _in_two(rows: DataFrame, *more: str) -> DataFrame:
    """(id, more, m, w): how many shingles h of rows(h, id, more) an id has that another id has too, and the sum of their rows' logarithms; none: no row."""
    of = W.partitionBy("h")
    first = F.lag("id").over(of.orderBy("id"))  # rows of one id, which copies of a text give, count once
    seen = rows.select("id", *more, (F.min("id").over(of) != F.max("id").over(of)).alias("_two"), (first.isNull() | (first != F.col("id"))).alias("_new"), F.count(F.lit(1)).over(of).alias("_of"))
    return seen.filter("_two and _new").groupBy("id").agg(*(F.max(c).alias(c) for c in more), F.count(F.lit(1)).alias("m"), F.sum(F.log2("_of")).alias("w"))


def _common(n: np.ndarray, least: float) -> np.ndarray:
    """How many elements a set of n has in common with one that is alike, at least."""
    return np.ceil(np.round(least * n, 9)).astype(np.int64)


def _text_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    words, firsts = word_hashes(data, offsets)
    return [row_shingles(words[i:j], width) for i, j in zip(firsts[:-1], firsts[1:], strict=True)]


def _chosen(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(ids) if ids.count() <= SEND_IDS else ids, "id", "left_semi")


def _sharing(texts: DataFrame, width: int, least: float) -> DataFrame:
    """(id): all that may be alike with another of texts(id, text), by the smallest hashes of each text.

    Of two alike sets of n and o or more elements in common, at least l are among the n - o + l smallest of either
    (for l up to the smaller o); l is a tenth of the set, and the other set has o elements or more.
    """
    tenth = lambda n: np.minimum(np.maximum(1, -(-n // 10)), _common(n, least))

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_slices(batch, "text"):
                sets = [np.unique(x) for x in _text_sets(data, offsets, width)]
                n = np.array(list(map(len, sets)), np.int64)
                common = _common(n, least)
                cut = n - common + tenth(n)
                of = lambda x: pa.array(np.repeat(x, cut))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[:k] for x, k in zip(sets, cut, strict=True)]).view(np.int64)), of(np.asarray(batch.column(0).slice(at, end - at))), of(tenth(common).astype(np.int32))], ["h", "id", "need"])

    found = _in_two(texts.select("id", "text").mapInArrow(smallest, "h long, id long, need int"), "need").filter("m >= need").select("id")
    empty = texts.filter(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).select("id")
    return kept(found.unionByName(empty).distinct())


def _sets(texts: DataFrame, width: int, least: float) -> DataFrame:
    """(id, fp, n, p, s): the shingle sets of those of texts(id, fp, text) that may be alike with another; p: sizes in 256 parts of the hash space."""
    one = _chosen(texts, _sharing(texts, width, least)).groupBy("id").agg(F.min("fp").alias("fp"), F.min("text").alias("text"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_slices(batch, "text"):
                sets = [np.unique((x >> np.uint64(32)).astype("<u4")) for x in _text_sets(data, offsets, width)]
                sizes = [np.bincount(x >> 24, minlength=256) for x in sets]
                # of sets too large for bytes: none, and so no bound
                parts = [x.astype(np.uint8).tobytes() if x.max() < 256 else b"" for x in sizes]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, end - at) for k in (0, 1)), pa.array(list(map(len, sets)), pa.int64()), pa.array(parts, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "fp", "n", "p", "s"])

    return written(one.select("id", "fp", "text").mapInArrow(shingles, "id long, fp long, n long, p binary, s binary"), "simhash-sets")


def _shared(sets: DataFrame, least: float) -> DataFrame:
    """(id, fp, n, m, w): of sets() those that have enough elements, m, which others have as well; w is larger the more have them."""

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                raw = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int64)), pa.array(np.repeat(np.asarray(part.column(0)), [len(x) // 4 for x in raw]))], ["h", "id"])

    m = _in_two(sets.select("id", "s").mapInArrow(elements, "h long, id long"))
    near = sets.select("id", "fp", "n").join(m, "id", "left").withColumn("w", (1000 * F.col("w") / F.nullif("n", F.lit(0))).cast("long"))
    return near.fillna(0, ["m", "w"]).filter(F.col("m") >= F.ceil(F.round(least * F.col("n"), 9)))


def _often(sets: DataFrame) -> np.ndarray:
    """How many elements of all sets fall into each of CELLS (a task adds 65,535 at most, which only changes the order)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                np.add.at(total, np.frombuffer(raw.as_buffer(), "<u4") & (CELLS - 1), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CELLS // PART)), pa.array([x.tobytes() for x in np.minimum(total, 65_535).astype("<u2").reshape(-1, PART)], pa.binary())], ["part", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), "<u2").astype(np.int64) for x in rows["counts"])
        return pa.table({"part": rows["part"][:1], "counts": pa.array([np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()], pa.binary())})

    parts = sets.select("s").mapInArrow(count, "part long, counts binary").groupBy("part").applyInArrow(add, "part long, counts binary").collect()
    return np.frombuffer(b"".join(bytes(r["counts"]) for r in sorted(parts, key=lambda r: r["part"])), "<u4")


def _rarest(sets: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """texts(id, fp, component, n, m) with (h, at), a row for each element of their prefixes in the order of rising counts; at: its place.

    Two alike sets share one of their first n - o + 1, where o of n are common at least. Empty sets meet by an h of their own.
    """
    texts = kept(texts)
    sent, names = sets.sparkSession.sparkContext.broadcast(_often(_chosen(sets, texts.select("id")))), texts.columns

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, found = batch.slice(i, 256), []
                for raw in part.column(len(names)):
                    x = np.frombuffer(raw.as_buffer(), "<u4")
                    often = sent.value[x & (CELLS - 1)]
                    rare = np.argsort(often, kind="stable")[: len(x) - int(_common(np.array([len(x)]), least)[0]) + 1]
                    at = np.flatnonzero(often[rare] > 1)  # the only one of its cell is in no other set
                    found.append((x[rare[at]].astype(np.int64), at) if len(x) else (np.array([-1]), np.array([0])))
                of = pa.array(np.repeat(np.arange(part.num_rows), [len(at) for _, at in found]))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(of) for k in range(len(names))), *(pa.array(np.concatenate(x)) for x in zip(*found, strict=True))], [*names, "h", "at"])

    own = sets.select("id", "s").join(F.broadcast(texts) if texts.count() <= SEND_IDS else texts, "id")
    return own.select(*names, "s").mapInArrow(first, ", ".join(f"{c} long" for c in [*names, "h", "at"]))


def _meeting(sets: DataFrame, distance: int, least: float) -> Callable[[DataFrame], DataFrame]:
    """The pairs (a, b) of texts(id, fp, component, n, m) of different components that may be alike by sets(id, s)."""

    def meet(texts: DataFrame) -> DataFrame:
        rows = written(_rarest(sets, texts, least), "simhash-rarest")
        # what stands in one component alone makes no pair, however many texts of it have it
        two = rows.groupBy("h").agg(F.min("component").alias("_min"), F.max("component").alias("_max")).filter("_min <> _max").select("h")
        rows = kept(rows.join(two, "h"))
        a, b = (rows.select(*(F.col(c).alias(f"{c}_{side}") for c in rows.columns)) for side in "ab")
        both, most = F.col("n_a") + F.col("n_b"), F.least("m_a", "m_b")
        # after the first common element no more can be shared than the shorter rest
        enough = (most >= least * (both - most)) & (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= least / (1 + least) * both - 1e-6)
        near = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= distance
        return a.join(b, (F.col("h_a") == F.col("h_b")) & (F.col("component_a") < F.col("component_b")) & near & enough).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))

    return meet


def _alike(sets: DataFrame, least: float) -> Callable[[DataFrame], DataFrame]:
    """A check of pairs of sets(id, n, p, s): Jaccard similarity.

    Sets' sizes in 256 parts of the hash space bound the common shingles from above; most pairs that are
    not alike go on these alone, and only the others meet with their sets.
    """
    alike = lambda same, n: same >= least * (n - same)

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = kept(pairs)

        def may_be(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = np.asarray(batch.column(2)).astype(np.int64) + np.asarray(batch.column(3))
                most = np.minimum(np.asarray(batch.column(2)), np.asarray(batch.column(3))).astype(np.int64)
                x, y = batch.column(4), batch.column(5)
                both = np.array([bool(len(u)) and bool(len(v)) for u, v in zip(x.to_pylist(), y.to_pylist(), strict=True)], bool)
                if both.any():
                    x, y = (np.frombuffer(b"".join(z.filter(pa.array(both)).to_pylist()), np.uint8).reshape(-1, 256) for z in (x, y))
                    most[both] = np.minimum(x, y).sum(1, dtype=np.int64)
                ok = pa.array(alike(most, n), pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(ok) for k in (0, 1)], ["a", "b"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = (np.frombuffer(v.as_buffer(), "<u4") for v in (x, y))
                    ok.append(bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y))))
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok, pa.bool_())) for k in (0, 1)], ["a", "b"])

        side = lambda of, *names: sets.select(F.col("id").alias(of), *(F.col(c).alias(f"{c}_{of}") for c in names))
        met = pairs.join(side("a", "n", "p"), "a").join(side("b", "n", "p"), "b").select("a", "b", "n_a", "n_b", "p_a", "p_b").mapInArrow(may_be, "a long, b long")
        return kept(met).join(side("a", "s"), "a").join(side("b", "s"), "b").select("a", "b", "s_a", "s_b").mapInArrow(compare, "a long, b long")

    return verify


def row_shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of a text's shingles; of fewer words, the whole sequence."""
    n = min(width, len(words))
    return ngrams(words, np.array([0, len(words)]), n)[0] if n else words


def deduplicated(docs: DataFrame, distance: int = 14, width: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each class of near copies: the smallest doc_id (nulls last), then the smallest hash of the text, then of the row.

    Texts are linked if their fingerprints differ by at most ``distance`` bits and their shingle sets
    have a Jaccard similarity of ``least`` or more; only equal texts (by a 64-bit hash of text and
    fingerprint) go without a check. Empty texts form one class, and null texts with them. Repeated rows are
    one class. Columns may have any names; an empty table gives no rows.
    """
    columns = docs.columns
    fp, of_text, component, order, of, first_of = name_apart(docs, "fp", "of_text", "component", "order", "of", "first_of")
    marked = written(with_fingerprint(docs, columns, fp, width).withColumn(of_text, F.xxhash64("text", fp)), "simhash")
    slim = marked.select(F.col(of_text).alias("id"), F.col(fp).alias("fp"), F.col("text").alias("text"))
    sets = _sets(slim, width, least)
    classes = kept(linked(_shared(sets, least), distance, _alike(sets, least), _meeting(sets, distance, least)).filter("id <> component").toDF(of, component))
    classes = F.broadcast(classes) if classes.count() <= SEND_IDS else classes
    # maps have no hash; rows that are alike in all else differ by their place alone
    hashed = [c for c in columns if "map<" not in docs.schema[c].dataType.simpleString()]
    key = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.xxhash64(*hashed), F.monotonically_increasing_id())
    named = marked.join(classes, F.col(of_text) == F.col(of), "left").withColumn(component, F.coalesce(component, of_text))
    named = written(named.withColumn(order, key).drop(of, of_text, fp), "simhash-classes")
    first = named.groupBy(component).agg(F.min(order).alias(first_of)).select(first_of)
    return named.join(first, F.col(order) == F.col(first_of), "left_semi").select(*columns)
