"""Substring dedup: passages that repeat, exactly or nearly, in different documents.

Two passages of at least ``least_words`` words with a Jaccard similarity of ``similarity`` on
``width``-word shingles have a run of ``RUN`` equal words: with e words changed n - width + 1 shingles
allow e <= (1 - s) / (1 + s) (n - width + 1) / width, and e changes leave a run of (n - e) / (e + 1),
which is 25 at the least (50 words, one change in the middle). So tokens are runs of ``TOKEN`` words,
and all runs of t = RUN - TOKEN + 1 tokens that share the position c of their min-hash form one compact
window (l, c, r): c's reach to the nearest smaller hash on either side, the node of the Cartesian tree.
Only positions that are the minimum of some run of t have one, about 2 n / (t + 1) for n words. A run of
RUN equal words has the same minimum in both texts, so one hash function finds every such passage;
``hashes`` may ask for more.

Windows of equal minimum form a group, and each meets the group's first one (the representative); the
reaches bound the interval of the passage on both sides of the minimum. Both texts' shingles around it
come from blocks of ``BLOCK`` words, and the passage is verified on them: it grows from the minimum
outward as long as at least ``similarity`` of its shingles are common, and counts if both sides have
``least_words`` words and the Jaccard similarity of their shingle sets is ``similarity``. Blocks cut
longer passages: a piece each, and every piece names the stretch that it and those next to it cover.

If a member of a group repeats no passage of its representative, it may still repeat another member's. On
50 words around c the two share all but (1 - s) / (1 + s) of the shingles (5), and not all of these can be
the representative's, so among each one's six nearest shingles before c, or after it, that the
representative lacks, one is common. Members meet again in groups of representative and such a shingle,
in rounds until no group has two documents, so no pair is lost; all but the rows of repeated text stand
alone and go. After ``ROUNDS`` rounds, groups of at most ``SETTLE`` members are settled in a task: in order,
every member meets those that nothing links to it yet. Larger groups take further rounds. Which way a group
goes depends on its own members alone, so other documents of the table don't change its rows.

Words: runs of anything but white space, ASCII lower case. Null, empty and short texts have no
windows. Texts of any length are cut whole. Repeats within one document, or between rows of one doc_id,
are not reported; other repeats of each of these rows are. Rows without doc_id take no part. Other columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import kept, mix, ngrams, text_slices, word_hashes, written

WIDTH, LEAST_WORDS, SIMILARITY, HASHES, TOKEN, RUN = 5, 50, 0.8, 1, 14, 24
REACH, SEND_IDS, BLOCK, MARGIN, FEW, ROUNDS, SETTLE = 65_535, 2_000_000, 512, 128, 20_000, 2, 64


def _sliding(x: np.ndarray, t: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """pick over every t values in a row, by block prefixes and suffixes."""
    n = len(x)
    full = np.concatenate([x, np.full(-n % t, fill, x.dtype)]).reshape(-1, t)
    ahead = pick.accumulate(full, 1).ravel()
    behind = pick.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return pick(behind[: n - t + 1], ahead[t - 1 : n])


def compact_windows(h: np.ndarray, t: int, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), inclusive: all runs of t or more within [l, r] that hold c have their (leftmost) minimum at c.

    Of equal minima less than t apart only the first has a window, unless ``every`` is asked for. A
    value of 0 separates texts: no window holds one.
    """
    none = np.zeros(0, np.int64)
    if len(h) < t:
        return none, none, none
    low = _sliding(h, t, np.minimum, np.iinfo(h.dtype).max)
    edge = np.zeros(t - 1, h.dtype)
    # a value is the minimum of some run if the largest minimum of the runs that hold it is the value
    c = np.flatnonzero((_sliding(np.concatenate([edge, low, edge]), t, np.maximum, 0) == h) & (h > 0))
    levels, x, size = [], h, 1  # minima of 1, 2, 4, .. values from each position on
    while len(x) and len(c):
        levels.append((size, x))
        if not x.any():  # every longer run holds a separator
            break
        x = np.minimum(x[:-size], x[size:]) if len(x) > size else x[:0]
        size *= 2
    value, left, right = h[c], c.copy(), c.copy()
    for size, low in reversed(levels):
        at = right + 1
        ok = at < len(low)
        ok &= low[np.minimum(at, len(low) - 1)] >= value
        right = np.where(ok, right + size, right)
        at = left - size
        ok = at >= 0
        ok &= (at < len(low)) & (low[np.clip(at, 0, len(low) - 1)] > value)
        left = np.where(ok, left - size, left)
    wide = right - left + 1 >= t
    if not every:
        wide &= ~((left > 0) & (h[np.maximum(left - 1, 0)] == value) & (c - left + 1 < t))
    return left[wide], c[wide], right[wide]


def same_before(h: np.ndarray, lo: np.ndarray, c: np.ndarray, hi: np.ndarray, t: int) -> np.ndarray:
    """Whether each window's runs of t that hold c repeat, value by value, runs that hold the equal minimum at lo - 1."""
    out = (lo > 0) & (h[np.maximum(lo - 1, 0)] == h[c]) & (c - lo + 1 < t)
    at, steps = np.flatnonzero(out), np.arange(t)
    for k in range(0, len(at), 10_000):
        part = at[k : k + 10_000]
        here, d = c[part, None], (c - lo + 1)[part, None]
        after = np.minimum(here + steps, hi[part, None])
        before = np.where(steps < d, here - steps, here)
        out[part] = (h[after] == h[after - d]).all(1) & ((before >= d) & (h[before] == h[np.maximum(before - d, 0)])).all(1)
    return out


def windows(docs: DataFrame, hashes: int = HASHES, token: int = TOKEN, run: int = RUN) -> DataFrame:
    """(key, doc_id, place): compact windows of runs of ``run`` words, by their minimum.

    place packs c and the reaches before and after it, in words (32, 16 and 16 bits); a reach of
    65,535 stands for any longer one.
    """
    t = run - token + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for at, _, data, offsets in text_slices(batch, "text"):
                words, firsts = word_hashes(data, offsets)
                if len(words) < run:
                    continue
                tokens, inside = ngrams(words, firsts, token)
                row = np.searchsorted(firsts, np.arange(len(tokens)), "right") - 1
                for f in range(hashes):
                    # tokens that reach into the next text separate the texts
                    h = np.where(inside, mix(tokens ^ np.uint64(0x9E3779B97F4A7C15 * (f + 1) & (1 << 64) - 1)) | np.uint64(1), np.uint64(0))
                    lo, c, hi = compact_windows(h, t, every=True)
                    new = ~same_before(h, lo, c, hi, t)
                    lo, c, hi = lo[new], c[new], hi[new]
                    reach = [np.minimum(x, REACH).astype(np.uint64) for x in (c - lo, hi - c)]
                    place = ((c - firsts[row[c]]).astype(np.uint64) << np.uint64(32)) | (reach[0] << np.uint64(16)) | reach[1]
                    key = mix(h[c] + np.uint64(f))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[at + row[c]]), pa.array(place.view(np.int64))], ["key", "doc_id", "place"])

    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut, "key long, doc_id long, place long")


def members(found: DataFrame, once: bool = False) -> DataFrame:
    """(key, doc_id, place, n): windows whose key stands in two documents or more; n: how many share it.

    ``once``: of groups of the same members (by count, ends and a 64-bit hash of all) one is enough; with
    ``first``, the smallest hash of a member.
    """
    # most keys stand in one document: those go first, on the keys and ids alone
    sums = [F.min("doc_id").alias("head"), F.max("doc_id").alias("last"), F.count("*").alias("n"), *([F.bit_xor(F.xxhash64("doc_id", "place")).alias("all"), F.min(F.xxhash64("doc_id", "place")).alias("first")] if once else [])]
    ids = found.groupBy("key").agg(*sums).filter(F.col("last") != F.col("head"))
    if once:
        ids = ids.groupBy("first", "last", "n", "all").agg(F.min("key").alias("key"))
    names = ["n", *(["first"] if once else [])]
    return found.join(ids.select(F.col("key").alias("_key"), *names), found.key == F.col("_key")).select("key", "doc_id", "place", *names)


def met_with_heads(rest: DataFrame) -> DataFrame:
    """(doc_id, place, head, head_place): each window and the first one of its group."""
    heads = rest.groupBy(F.col("key").alias("_key")).agg(F.min(F.struct("doc_id", "place")).alias("_head"))
    met = rest.join(heads, rest["key"] == F.col("_key")).select("doc_id", "place", F.col("_head.doc_id").alias("head"), F.col("_head.place").alias("head_place"))
    return met.filter((F.col("doc_id") != F.col("head")) | (F.col("place") != F.col("head_place")))


def block_of(place: str) -> F.Column:
    return F.expr(f"shiftrightunsigned({place}, 32) div {BLOCK}")


def shingle_blocks(docs: DataFrame, need: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, block, cells): shingle hashes (32 bits) of each block of texts and MARGIN around it, for the needed (doc_id, block)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for at, _, data, offsets in text_slices(batch, "text"):
                words, firsts = word_hashes(data, offsets)
                grams, _ = ngrams(words, firsts, width)
                grams = (grams >> np.uint64(32)).astype("<u4")
                doc, block, cells = [], [], []
                for r, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
                    b = max(a, b - width + 1)
                    for k in range(-(-(b - a) // BLOCK)):
                        doc.append(ids[at + r])
                        block.append(k)
                        cells.append(grams[max(a, a + k * BLOCK - MARGIN) : min(b, a + (k + 1) * BLOCK + MARGIN)].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(block, pa.int64()), pa.array(cells, pa.binary())], ["doc", "block", "cells"])

    ids = kept(need.select(F.col("doc_id").alias("_id")).distinct())
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # 16 MB of ids at the most; more are joined by a shuffle
    wanted = rows.join(F.broadcast(ids) if ids.count() <= SEND_IDS else ids, F.col("doc_id") == F.col("_id"), "left_semi")
    cut_up = wanted.mapInArrow(cut, "doc long, block long, cells binary")
    return cut_up.join(need, (F.col("doc") == need["doc_id"]) & (cut_up["block"] == need["block"]), "left_semi").groupBy("doc", "block").agg(F.max("cells").alias("cells"))


def _grown(common: np.ndarray, seed: int, similarity: float) -> list[tuple[int, int]]:
    """Shingles around the seed, first and last, of which enough are common: the longest stretch, and the densest.

    With a share f of common shingles in both texts the Jaccard similarity is f / (2 - f), so each
    one that is not common must be paid for by 2 s / (1 - s) others.
    """
    gain = np.where(common, 1.0, -2 * similarity / (1 - similarity + 1e-9))
    right, left = np.cumsum(gain[seed:]), np.cumsum(gain[seed::-1]) - gain[seed]
    last = lambda x, least: int(np.flatnonzero(x >= least)[-1])
    r = last(right + left.max(), 0.0) if right[0] + left.max() >= 0 else 0
    n = last(left + right[r], min(0.0, left.max() + right[r]))
    longest = (seed - n, seed + r)
    densest = (seed - last(left, left.max()), seed + last(right, right.max()))
    return [longest, densest]


def _same_run(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """How far equal shingles reach before and after a[i], b[j]."""
    n = min(len(a) - i, len(b) - j)
    apart = np.flatnonzero(a[i : i + n] != b[j : j + n])
    after = (int(apart[0]) if len(apart) else n) - 1
    m = min(i, j)
    apart = np.flatnonzero(a[i - m : i][::-1] != b[j - m : j][::-1])
    return (int(apart[0]) if len(apart) else m), after


def passages_of(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, diagonal: int, seeds: list[int], start: int, end: int, least_words: int, width: int, similarity: float) -> list[tuple]:
    """Verified (start, end, other start, other end, words, similarity) in words; a, b: shingle hashes; in_a, in_b: which the other has."""
    out: list[tuple] = []
    slack, failed = least_words, -1
    lo, hi = max(0, start - slack), min(len(a), end + slack + 1)
    lo_b, hi_b = max(0, lo - diagonal - slack), min(len(b), hi - diagonal + slack)
    for c in sorted(seeds):
        # a seed in a passage, or in the equal run of one that led to none, has nothing to add
        if c <= failed or (out and out[-1][0] <= c < out[-1][1] - width + 1):
            continue
        i, j = c - lo, c - diagonal - lo_b
        before, after = _same_run(a[lo:hi], b[lo_b:hi_b], i, j)
        tries = [*zip(_grown(in_a[lo:hi], i, similarity), _grown(in_b[lo_b:hi_b], j, similarity), strict=True), ((i - before, i + after), (j - before, j + after))]
        for (s, e), (s2, e2) in tries:
            n, n2 = e - s + width, e2 - s2 + width
            if min(n, n2) < least_words:
                continue
            x, y = set(a[lo + s : lo + e + 1].tolist()), set(b[lo_b + s2 : lo_b + e2 + 1].tolist())
            same = len(x & y)
            jaccard = same / (len(x) + len(y) - same)
            if jaccard >= similarity:
                out.append((lo + s, lo + s + n, lo_b + s2, lo_b + s2 + n2, n, jaccard))
                break
        else:
            found = _shortest(a[lo:hi], b[lo_b:hi_b], in_a[lo:hi], i, i - j, least_words - width + 1, similarity)
            if found:
                (s, n), (s2, n2), jaccard = found
                out.append((lo + s, lo + s + n + width - 1, lo_b + s2, lo_b + s2 + n2 + width - 1, n + width - 1, jaccard))
            else:
                failed = c + after
    return out


def _shortest(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, seed: int, diagonal: int, size: int, similarity: float) -> tuple | None:
    """((start, shingles), (start, shingles), similarity) of a passage of least length, or one word more, around the seed; else None."""
    total, need = np.concatenate([[0], np.cumsum(in_a)]), size - int((1 - similarity) / (1 + similarity) * size + 1e-9)
    for n in (size, size + 1):
        starts = np.arange(max(0, seed - n + 1), min(seed, len(a) - n) + 1)
        for s in starts[total[starts + n] - total[starts] >= need].tolist():
            x = set(a[s : s + n].tolist())
            for n2 in (size, size + 1):
                for s2 in range(max(0, s - diagonal - 2), min(len(b) - n2, s - diagonal + 2) + 1):
                    y = set(b[s2 : s2 + n2].tolist())
                    same = len(x & y)
                    if same >= similarity * (len(x) + len(y) - same):
                        return (s, n), (s2, n2), same / (len(x) + len(y) - same)
    return None


def _lacking(out: np.ndarray, token: int, width: int, least_words: int, most: int, c: np.ndarray) -> np.ndarray:
    """Shingle positions of a block, by seed: the ``most`` nearest on either side that are marked ``out``, else -1."""
    where, k = np.append(np.flatnonzero(out), [-1]), np.arange(most)
    left = where[np.maximum(np.searchsorted(where[:-1], c)[:, None] - 1 - k, -1)]
    right = where[np.minimum(np.searchsorted(where[:-1], c + token - width, "right")[:, None] + k, len(where) - 1)]
    first, last = (c + token - least_words)[:, None], (c + least_words - width)[:, None]
    return np.concatenate([np.where(left >= first, left, -1), np.where(right <= last, right, -1)], 1)


def _held(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x stand in y; for arrays as short as these, one sort and a search in it beat np.isin."""
    if not len(y):
        return np.zeros(len(x), bool)
    y = np.sort(y)
    return np.take(y, np.searchsorted(y, x), mode="clip") == x


def compared(pairs: DataFrame, blocks: DataFrame, least_words: int, width: int, similarity: float, token: int = TOKEN) -> DataFrame:
    """(doc_id, other_id, found, seeds) of pairs(doc_id, place, head, head_place): verified passages, and of each place whether it is in one and its ``lack``."""
    most = int((1 - similarity) / (1 + similarity) * (least_words - width + 1) + 1e-9) + 1
    cells = pairs.groupBy("doc_id", block_of("place").alias("block"), "head", block_of("head_place").alias("head_block")).agg(F.collect_set(F.struct("place", "head_place")).alias("met"))
    a, b = blocks.toDF("_a", "_ka", "a"), blocks.toDF("_b", "_kb", "b")
    joined = cells.join(a, (F.col("doc_id") == F.col("_a")) & (F.col("block") == F.col("_ka"))).join(b, (F.col("head") == F.col("_b")) & (F.col("head_block") == F.col("_kb")))
    low = lambda x: (x & np.uint64(REACH)).astype(np.int64)
    span = pa.list_(pa.struct([(n, pa.float64() if n == "similarity" else pa.int64()) for n in SPAN]))

    def one(x: np.ndarray, y: np.ndarray, x_from: int, y_from: int, place: np.ndarray, head_place: np.ndarray, same_doc: bool) -> tuple[list, np.ndarray, np.ndarray]:
        c, c2 = ((p >> np.uint64(32)).astype(np.int64) - s for p, s in ((place, x_from), (head_place, y_from)))
        if len(x) == len(y) and (x == y).all():
            in_x = in_y = np.ones(len(x), bool)
        else:
            in_x, in_y = _held(x, y), _held(y, x)
        before, after = (np.minimum(low(place >> np.uint64(k)), low(head_place >> np.uint64(k))) for k in (16, 0))
        spans, ok = [], np.zeros(len(c), bool)
        for d in [] if same_doc else np.unique(c - c2).tolist():
            here = np.flatnonzero(c - c2 == d)
            for s in passages_of(x, y, in_x, in_y, d, c[here].tolist(), int((c - before)[here].min()), int((c + after)[here].max()) + token, least_words, width, similarity):
                spans.append((s[0] + x_from, s[1] + x_from, s[2] + y_from, s[3] + y_from, s[4], s[5]))
                ok[here] |= (s[0] <= c[here]) & (c[here] + token <= s[1])
        lack = _lacking(~in_x, token, width, least_words, most, c)
        # almost all around it stands somewhere in the other block, and yet there is no passage: by what is near
        total = np.concatenate([[0], np.cumsum(in_x)])
        around = total[np.minimum(c + least_words - width + 1, len(x))] - total[np.maximum(c + token - least_words, 0)]
        for i in [] if same_doc else np.flatnonzero(~ok & (around > least_words - width + 1 - most)):
            near = y[max(0, c2[i] + token - least_words) : c2[i] + least_words - width + 1]
            lo = max(0, c[i] + token - least_words)
            own = _lacking(~_held(x[lo : c[i] + least_words - width + 1], near), token, width, least_words, most, c[i : i + 1] - lo)[0]
            lack[i] = np.where(own >= 0, own + lo, -1)
        return spans, ok, lack

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, block, head, head_block = (np.asarray(batch.column(k)) for k in range(4))
            met = batch.column(4)
            at, place, head_place = np.asarray(met.offsets), *(np.asarray(met.values.field(k)).view(np.uint64) for k in (0, 1))
            found, oks, lacks, sizes = [], [np.zeros(0, bool)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(batch.num_rows):
                p, q = place[at[i] : at[i + 1]], head_place[at[i] : at[i + 1]]
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), "<u4") for k in (5, 6))
                spans, ok, lack = one(x, y, max(0, int(block[i]) * BLOCK - MARGIN), max(0, int(head_block[i]) * BLOCK - MARGIN), p, q, doc[i] == head[i])
                found.append([dict(zip(SPAN, s, strict=True)) for s in spans])
                oks.append(ok)
                lacks.append(x[lack[lack >= 0]].astype(np.int64))
                sizes.append((lack >= 0).sum(1))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
            cells = [pa.array(x[at[0] : at[-1]].view(np.int64)) for x in (place, head_place)]
            cells = pa.StructArray.from_arrays([*cells, pa.array(np.concatenate(oks)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lacks)))], ["place", "head_place", "ok", "lack"])
            seeds = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), cells)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, span), seeds], ["doc_id", "other_id", "found", "seeds"])

    fields = ",".join(f"{n}:{'double' if n == 'similarity' else 'bigint'}" for n in SPAN)
    schema = f"doc_id long, other_id long, found array<struct<{fields}>>, seeds array<struct<place:bigint,head_place:bigint,ok:boolean,lack:array<bigint>>>"
    return joined.select("doc_id", "block", "head", "head_block", "met", "a", "b").mapInArrow(verify, schema)


SPAN = ("start_word", "end_word", "other_start", "other_end", "n_words", "similarity")


def settled(rest: DataFrame, size: int, blocks: DataFrame, least_words: int, width: int, similarity: float, token: int = TOKEN) -> DataFrame:
    """(doc_id, other_id, passage): verified passages that link the members of the small groups of ``rest``, of ``size`` rows.

    A member brings the shingles within MARGIN of its minimum, and a task's groups have some 1,000 members
    together. Groups whose member of the smallest hash is the same come to one task, which compares two windows only once.
    """
    need = least_words - width + 1 - int((1 - similarity) / (1 + similarity) * (least_words - width + 1) + 1e-9)
    cells = blocks.toDF("_doc", "_block", "cells")
    rows = rest.withColumn("block", block_of("place")).join(cells, (F.col("doc_id") == F.col("_doc")) & (F.col("block") == F.col("_block")))
    start, begin = (F.greatest(F.lit(0), x - MARGIN).cast("int") for x in (F.col("block") * BLOCK, F.expr("shiftrightunsigned(place, 32)")))
    near = rows.select(F.pmod("first", F.lit(1 + size // 1000)).alias("part"), "key", "doc_id", "place", begin.alias("begin"), F.col("cells").substr(4 * (begin - start) + 1, F.lit(4 * (2 * MARGIN + token))).alias("cells"))

    def settle(part: pa.Table) -> pa.Table:
        part = part.sort_by([("key", "ascending"), ("doc_id", "ascending"), ("place", "ascending")])
        doc, begin = (np.asarray(part[k]).astype(np.int64) for k in ("doc_id", "begin"))
        place, key = np.asarray(part["place"]).view(np.uint64), np.asarray(part["key"])
        texts = [np.frombuffer(x.as_buffer(), "<u4") for x in part["cells"]]
        c = (place >> np.uint64(32)).astype(np.int64) - begin
        before, after = (((place >> np.uint64(k)) & np.uint64(REACH)).astype(np.int64) for k in (16, 0))
        around = [x[max(0, k + token - least_words) : k + least_words - width + 1].tolist() for x, k in zip(texts, c.tolist(), strict=True)]
        sets = list(map(set, around))
        of, out, seen = list(range(len(doc))), [], {}
        own = list(zip(doc.tolist(), place.tolist(), strict=True))
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            for j in range(lo, hi):
                for i in range(j + 1, hi):
                    # a passage of least length has that many common shingles around the minimum
                    if of[i] == of[j] or doc[i] == doc[j] or sum(map(sets[j].__contains__, around[i])) < need:
                        continue
                    linked = seen.get((own[i], own[j]))
                    if linked is None:
                        x, y = texts[i], texts[j]
                        back, on = min(before[i], before[j]), min(after[i], after[j])
                        found = passages_of(x, y, _held(x, y), _held(y, x), int(c[i] - c[j]), [int(c[i])], int(c[i] - back), int(c[i] + on) + token, least_words, width, similarity)
                        out += [(doc[i], doc[j], s[0] + begin[i], s[1] + begin[i], s[2] + begin[j], s[3] + begin[j], s[4], s[5]) for s in found]
                        linked = seen[own[i], own[j]] = bool(found)
                    if linked:
                        was, now = of[i], of[j]
                        of[lo:hi] = [now if k == was else k for k in of[lo:hi]]
        return pa.table({n: pa.array([x[k] for x in out], pa.float64() if n == "similarity" else pa.int64()) for k, n in enumerate(("doc_id", "other_id", *SPAN))})

    fields = ", ".join(f"{n} {'double' if n == 'similarity' else 'long'}" for n in ("doc_id", "other_id", *SPAN))
    return near.groupBy("part").applyInArrow(settle, fields).distinct()


STRETCH = ("stretch_start", "stretch_end", "other_stretch_start", "other_stretch_end")


def in_stretches(found: DataFrame) -> DataFrame:
    """Passages with the stretch of each: of one pair of documents, those that overlap in both, directly or by others, have one.

    Rows come in the order of their start, so only the stretches that reach past the last one are held.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held, done = None, [], []  # held: (all rows, those that reach past the last start) of the pair's stretches

        def ready() -> pa.RecordBatch:
            rows = []
            for of, _ in done:
                starts, ends = ([pick(x[k] for x in of) for k in at] for pick, at in ((min, (2, 4)), (max, (3, 5))))
                rows += [(*x, starts[0], ends[0], starts[1], ends[1]) for x in of]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.float64() if n == "similarity" else pa.int64()) for k, n in enumerate(names)], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != pair:
                    done, held, pair = done + held, [], row[:2]
                apart, of, live = [], [row], [row]
                for rows, open_ in held:
                    open_ = [x for x in open_ if x[3] > row[2]]
                    if not open_:
                        done.append((rows, open_))
                    elif any(x[4] < row[5] and row[4] < x[5] for x in open_):
                        of, live = rows + of, open_ + live
                    else:
                        apart.append((rows, open_))
                held = [*apart, (of, live)]
            yield ready()
        done += held
        yield ready()

    names = ["doc_id", "other_id", *SPAN, *STRETCH]
    order = ["doc_id", "other_id", *SPAN]
    fields = ", ".join(f"{n} {'double' if n == 'similarity' else 'long'}" for n in names)
    return found.select(*order).repartition("doc_id", "other_id").sortWithinPartitions(*order).mapInArrow(name, fields)


def regrouped(seen: DataFrame) -> DataFrame:
    """(key, doc_id, place): windows of groups of which a member repeats nothing of the first one, by what they have and it lacks."""
    rows = seen.select("doc_id", "other_id", F.explode("seeds").alias("s")).select("doc_id", "other_id", "s.*")
    # another place in the head's own document is no repeat of it, and no failure
    failed = rows.groupBy(F.col("other_id").alias("_h"), F.col("head_place").alias("_p")).agg(F.min("doc_id").alias("_x"), F.max("doc_id").alias("_y"), F.bool_and(F.col("ok") | (F.col("doc_id") == F.col("other_id"))).alias("_all"))
    live = failed.filter((F.col("_x") != F.col("_y")) & ~F.col("_all"))
    again = rows.join(live, (F.col("other_id") == F.col("_h")) & (F.col("head_place") == F.col("_p")), "left_semi")
    return again.select("doc_id", "place", "other_id", "head_place", F.explode("lack").alias("g")).select(F.xxhash64("other_id", "head_place", "g").alias("key"), "doc_id", "place").distinct()


def apart(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(docs with an id for each text, (_row, _own) of the ids that stand for a repeated doc_id, or None).

    Rows that share a doc_id but not their text are documents of their own until the results are named.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull())
    twice = kept(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_own")))
    if not twice.head(1):
        return rows, None
    same = F.col("doc_id") == F.col("_own")
    row = F.xxhash64("doc_id", "text")
    named = kept(rows.join(twice, same).select(row.alias("_row"), F.col("doc_id").alias("_own")).distinct())
    single = rows.join(twice, same, "left_anti")
    return single.unionByName(rows.join(twice, same, "left_semi").select(row.alias("doc_id"), "text").dropDuplicates(["doc_id"])), named


def named_again(found: DataFrame, names: DataFrame) -> DataFrame:
    """Passages with doc_ids in place of the rows' ids, the smaller one as the other; none within one doc_id."""
    for c in ("doc_id", "other_id"):
        found = found.join(names, F.col(c) == F.col("_row"), "left").withColumn(c, F.coalesce("_own", c)).drop("_row", "_own")
    swap = F.col("doc_id") < F.col("other_id")
    pairs = {"doc_id": "other_id", "start_word": "other_start", "end_word": "other_end", "stretch_start": "other_stretch_start", "stretch_end": "other_stretch_end"}
    turned = {a: F.when(swap, F.col(b)).otherwise(F.col(a)) for a, b in (pairs | {b: a for a, b in pairs.items()}).items()}
    return found.filter("doc_id <> other_id").select(*[turned.get(c, F.col(c)).alias(c) for c in found.columns]).distinct()


def repeated(docs: DataFrame, hashes: int = HASHES, least_words: int = LEAST_WORDS, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, other_id, start_word, end_word, other_start, other_end, n_words, similarity) and the stretch around it.

    A passage of doc_id that repeats one of other_id, a representative of its class; ends exclusive. Rows
    that share a doc_id are looked at text by text. stretch_start, stretch_end, other_stretch_start and
    other_stretch_end bound what overlapping passages of the two documents cover together.
    """
    docs, names = apart(docs)
    found = _repeated(docs, hashes, least_words, width, similarity)
    return found if names is None else named_again(found, names)


def _repeated(docs: DataFrame, hashes: int, least_words: int, width: int, similarity: float) -> DataFrame:
    rest = kept(members(windows(docs, hashes)))
    blocks = written(shingle_blocks(docs, rest.select("doc_id", block_of("place").alias("block")).distinct(), width), "passages")
    out, size, rounds = None, rest.count(), 0
    while out is None or size:
        rounds += 1
        # rounds of few rows run in one partition, which needs no shuffles
        few = (lambda df: kept(df).coalesce(1)) if size <= FEW else (lambda df: df)
        met, near = few(met_with_heads(few(rest))), blocks
        if size <= FEW:
            ends = [met.select(F.col(doc).alias("_doc"), block_of(place).alias("_block")) for doc, place in (("doc_id", "place"), ("head", "head_place"))]
            near = few(blocks.join(F.broadcast(ends[0].unionByName(ends[1]).distinct()), (F.col("doc") == F.col("_doc")) & (F.col("block") == F.col("_block")), "left_semi"))
        seen = written(compared(met, near, least_words, width, similarity), "passages-met")
        found = seen.select("doc_id", "other_id", F.inline("found"))
        out = found if out is None else out.unionByName(found)
        rest = kept(members(regrouped(seen.coalesce(1) if size <= FEW else seen), once=True))
        size = rest.count()
        if size and rounds >= ROUNDS:
            small = rest.filter(F.col("n") <= SETTLE)
            out = out.unionByName(written(settled(small, size, blocks, least_words, width, similarity), "passages-settled"))
            rest = rest.filter(F.col("n") > SETTLE)
            size = rest.count()
    return in_stretches(out.distinct())
