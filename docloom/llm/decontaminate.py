"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of ASCII letters and digits and of other scripts' bytes, in ASCII lower case. The
n-grams of all test items are counted over the whole corpus; in every ``window`` n-grams in a row
of an item the rarest one is a seed, so that any ``window + n - 1`` words copied in a row hold
one, however common the copied passage is. A seed in a training text proposes an alignment; the
words around it are aligned locally with the item. The score is the alignment's share of the
score of a full copy; items of fewer than n words are matched as a whole.

The test items are handled in blocks of at most ``block_words`` words (a documented bound of what
is sent to the executors and kept on the driver, some 50 MB); a larger benchmark takes more passes.

Null and empty texts and items have no words and match nothing; an item_id may be null. Repeated rows and
items each match, ties of seeds go to the first. Texts of any length are scanned whole. Empty tables give
no rows. Columns may have any names but ``out``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import name_apart, ngrams, text_slices, word_hashes

N, WINDOW, LEAST, BLOCK_WORDS = 4, 2, 0.6, 200_000
MATCH, OTHER, GAP = 2, -1, -1
HITS = "array<struct<item_id:long,score:double,doc_start:int,doc_end:int,item_start:int,item_end:int,n_seeds:int>>"


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int, int]:
    """Best local alignment of two word sequences: score, and both spans (ends exclusive)."""
    m, n = len(item), len(text)
    score = np.zeros((m + 1, n + 1), np.int32)
    at = np.arange(n + 1, dtype=np.int32) * -GAP
    for i in range(1, m + 1):
        row = np.maximum(score[i - 1] + GAP, 0)
        row[1:] = np.maximum(row[1:], score[i - 1, :-1] + np.where(text == item[i - 1], MATCH, OTHER))
        score[i] = np.maximum.accumulate(row + at) - at
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    end, best = (int(i), int(j)), int(score[i, j])
    while i and j and score[i, j] > 0:
        if score[i, j] == score[i - 1, j - 1] + (MATCH if text[j - 1] == item[i - 1] else OTHER):
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return best, int(j), end[1], int(i), end[0]


def _item_words(texts: list[str | None]) -> list[np.ndarray]:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])
    out = []
    for _, _, data, offsets in text_slices(batch, "t"):
        words, firsts = word_hashes(data, offsets, alnum=True)
        out += [words[a:b] for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
    return out


class _Table:
    """Sorted hashes behind a small bitmap."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, grams: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions that hold one of the hashes, and which."""
        maybe = np.flatnonzero(self.bits[(grams >> np.uint64(44)).astype(np.int64)] & inside)
        if not len(self.hashes):
            return maybe[:0], maybe[:0]
        k = np.minimum(np.searchsorted(self.hashes, grams[maybe]), len(self.hashes) - 1)
        ok = self.hashes[k] == grams[maybe]
        return maybe[ok], k[ok]


def _sizes(items: list[np.ndarray], n: int) -> list[int]:
    """n, and the lengths of the items that are shorter."""
    return sorted({n} | {len(x) for x in items if 0 < len(x) < n})


def _grams(items: list[np.ndarray], n: int) -> list[tuple[int, np.ndarray]]:
    return [(min(n, len(x)), ngrams(x, np.array([0, len(x)]), min(n, len(x)))[0]) for x in items if len(x)]


def _counts(docs: DataFrame, tables: dict[int, _Table]) -> dict[int, np.ndarray]:
    """How often each n-gram of the tables occurs in the whole corpus."""
    sent = docs.sparkSession.sparkContext.broadcast(tables)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(t.hashes), np.int64) for k, t in sent.value.items()}
        for batch in batches:
            for _, _, data, offsets in text_slices(batch, "text"):
                words, firsts = word_hashes(data, offsets, alnum=True)
                for k, t in sent.value.items():
                    total[k] += np.bincount(t.find(*ngrams(words, firsts, k))[1], minlength=len(t.hashes))
        for k, x in total.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(x[at])], ["k", "at", "n"])

    out = {k: np.zeros(len(t.hashes), np.int64) for k, t in tables.items()}
    for r in docs.select("text").mapInArrow(count, "k long, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).collect():
        out[r["k"]][r["at"]] = r["n"]
    return out


def _seeds(items: list[np.ndarray], counts: dict[int, np.ndarray], tables: dict[int, _Table], n: int, window: int) -> dict[int, dict[int, list[tuple[int, int]]]]:
    """By size and hash: the (item, position) of the seeds."""
    out: dict[int, dict[int, list[tuple[int, int]]]] = {k: {} for k in tables}
    for i, x in enumerate(items):
        if not len(x):
            continue
        k = min(n, len(x))
        grams = ngrams(x, np.array([0, len(x)]), k)[0]
        often = counts[k][np.searchsorted(tables[k].hashes, grams)]
        picked = {min(range(a, min(a + window, len(grams))), key=lambda p: (often[p], p)) for a in range(max(1, len(grams) - window + 1))}
        for p in picked:
            out[k].setdefault(int(grams[p]), []).append((i, p))
    return out


def with_hits(docs: DataFrame, benchmark: DataFrame, columns: list[str], out: str = "hits", n: int = N, window: int = WINDOW, least: float = LEAST, block_words: int = BLOCK_WORDS, clean_only: bool = False) -> DataFrame:
    """The given columns of docs and an array of the test items that the text holds.

    ``clean_only``: only rows without any, and without the array.
    """
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = F.size(F.split("text", r"\s+"))
    total = items.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField(out, T.ArrayType(T._parse_datatype_string(HITS).elementType))])
    text, hits = name_apart(docs, "_hit_text", "_hits")
    found = docs.select(*columns, F.col("text").alias(text), F.lit(None).cast(HITS).alias(hits))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        words = _item_words([r["text"] for r in rows])
        by_size: dict[int, list[np.ndarray]] = {k: [] for k in _sizes(words, n)}
        for k, grams in _grams(words, n):
            by_size[k].append(grams)
        tables = {k: _Table(np.concatenate(x) if x else np.zeros(0, np.uint64)) for k, x in by_size.items()}
        counts = _counts(docs.select("text"), tables)
        seeds = _seeds(words, counts, tables, n, window)
        tables = {k: _Table(np.fromiter(s, np.uint64, len(s))) for k, s in seeds.items()}
        sent = docs.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], words, seeds, tables))
        more = T.StructType([*found.schema.fields])
        found = found.mapInArrow(_scan(sent, least, text), more)
    if clean_only:
        return found.filter(F.col(hits).isNull() | (F.size(hits) == 0)).select(*columns)
    return found.select(*columns, F.coalesce(hits, F.array().cast(HITS)).alias(schema.fields[-1].name))


def _scan(sent, least: float, text: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items, seeds, tables = sent.value
        memo: dict = {}
        for batch in batches:
            for at, end, data, offsets in text_slices(batch, text):
                words, firsts = word_hashes(data, offsets, alnum=True)
                near: dict[tuple[int, int], list[int]] = {}
                for k, t in tables.items():
                    where, which = t.find(*ngrams(words, firsts, k))
                    rows = np.searchsorted(firsts, where, "right") - 1
                    for p, h, r in zip(where.tolist(), which.tolist(), rows.tolist(), strict=True):
                        for i, q in seeds[k][int(t.hashes[h])]:
                            near.setdefault((r, i), []).append(p - q)
                hits: dict[int, list[dict]] = {}
                for (r, i), diagonals in near.items():
                    for hit in _aligned(words[firsts[r] : firsts[r + 1]], items[i], [d - firsts[r] for d in diagonals], least, (i, memo)):
                        hits.setdefault(r, []).append({"item_id": ids[i]} | hit)
                part = batch.slice(at, end - at)
                if hits:
                    old = part.column(part.num_columns - 1).to_pylist()
                    cells = pa.array([(old[r] or []) + hits[r] if r in hits else old[r] for r in range(end - at)], part.schema.field(part.num_columns - 1).type)
                    part = pa.RecordBatch.from_arrays([*part.columns[:-1], cells], names=part.schema.names)
                yield part

    return scan


def _aligned(text: np.ndarray, item: np.ndarray, diagonals: list[int], least: float, key: tuple) -> Iterator[dict]:
    m = len(item)
    slack = 4 + m // 4
    spans: list[list[int]] = []  # start, end, seeds; seeds on near diagonals share one alignment
    for d in sorted(diagonals):
        a, b = max(0, d - slack), min(len(text), d + m + slack)
        if spans and d - spans[-1][3] <= slack:
            spans[-1][1], spans[-1][2], spans[-1][3] = b, spans[-1][2] + 1, d
        else:
            spans.append([a, b, 1, d])
    item_no, memo = key
    for a, b, n, _ in spans:
        part = text[a:b]
        name = (item_no, part.tobytes())
        if name not in memo:
            if len(memo) > 20_000:
                memo.clear()
            memo[name] = align(part, item)
        best, j, j2, i, i2 = memo[name]
        if best >= least * MATCH * m:
            yield {"score": best / (MATCH * m), "doc_start": int(a + j), "doc_end": int(a + j2), "item_start": i, "item_end": i2, "n_seeds": n}


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each alignment: doc_id, item_id, score (to 1), spans in words of text and item, seeds met."""
    found = with_hits(docs, benchmark, ["doc_id"], **options).filter(F.size("hits") > 0)
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows whose text holds a test item."""
    return with_hits(docs, benchmark, docs.columns, clean_only=True, **options)
