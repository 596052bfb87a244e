"""Periodic runs of words: longest common extensions on suffix trees, candidates from Lyndon roots.

Words that are too rare in a stretch to repeat four times cut it, until nothing more can be cut: no run
crosses a cut, so ordinary prose seldom reaches the trees. The stretches left, as integers, of one long
document or of several short ones, stand one after another with a symbol of its own between each two.
Ukkonen's algorithm makes the suffix trees of that row and of its reversal; the depths along an Euler
tour, with a table of minima over powers of two, give the depth of the lowest common ancestor of two
leaves, which is the longest common extension, in constant time. Every run has the longest Lyndon word
at one of its places, under the order of symbols or its reverse, as its root; that word ends where the
next smaller (or larger) suffix starts. Each such root is extended in both directions, and what is long
enough is a run. All work is linear in the words, but for the table of minima.

A document is one row and stays in one task; memory grows with the longest stretch of one document.
Null and empty texts have no runs. Rows may repeat, columns may have any names, and ids may be null.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docloom.llm.common import name_apart

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
#: Words whose stretches get one pair of trees; a longer document gets its own pair.
TOGETHER = 8_000


def stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the parts of a document (its words as integers) in which every word occurs TIMES times or more."""
    found, open_ = [], [(0, len(words))]
    while open_:
        start, end = open_.pop()
        if end - start < LEAST:
            continue
        part = words[start:end]
        if end - start > 64:
            _, same, often = np.unique(part, return_inverse=True, return_counts=True)
            rare = np.flatnonzero(often[same] < TIMES)
        else:
            cells = part.tolist()
            count: dict[int, int] = {}
            for x in cells:
                count[x] = count.get(x, 0) + 1
            rare = np.array([i for i, x in enumerate(cells) if count[x] < TIMES], np.int64)
        if not len(rare):
            found.append((start, end))
            continue
        edges = np.concatenate([[-1], rare, [end - start]])
        long = np.flatnonzero(np.diff(edges) > LEAST)
        open_ += [(start + int(edges[k]) + 1, start + int(edges[k + 1])) for k in long]
    return found


class SuffixTree:
    """Ukkonen's tree of a list of integers whose last one occurs once; extensions by the Euler tour."""

    def __init__(self, s: list[int]) -> None:
        n, size = len(s), max(s) + 1
        start, end, link, to = [0], [0], [0], {}
        node = edge = length = rest = 0
        for i, symbol in enumerate(s):
            rest += 1
            last = 0
            while rest:
                if not length:
                    edge = i
                key = node * size + s[edge]
                child = to.get(key)
                if child is None:
                    to[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    a = start[child]
                    long = end[child] - a
                    if length >= long:
                        edge, length, node = edge + long, length - long, child
                        continue
                    if s[a + length] == symbol:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(start)
                    start += [a, i]
                    end += [a + length, n]
                    link += [0, 0]
                    to[key] = split
                    to[split * size + symbol] = split + 1
                    start[child] = a + length
                    to[split * size + s[a + length]] = child
                    if last:
                        link[last] = split
                    last = split
                rest -= 1
                if not node and length:
                    length -= 1
                    edge = i - rest + 1
                else:
                    node = link[node]
        # children of each node in the order of their symbols
        keys, nodes = np.fromiter(to.keys(), np.int64, len(to)), np.fromiter(to.values(), np.int64, len(to))
        order = np.argsort(keys)
        at = np.searchsorted(keys[order] // size, np.arange(len(start) + 1)).tolist()
        child = nodes[order].tolist()
        # depths of inner nodes each time that the tour comes back to one; a leaf stands before its parent's depth
        tour, leaves, places, stack = [], [], [], []
        k, stop, depth = at[0], at[1], 0
        while True:
            if k < stop:
                c = child[k]
                k += 1
                if at[c] == at[c + 1]:
                    leaves.append(start[c] - depth)
                    places.append(len(tour))
                    tour.append(depth)
                else:
                    stack.append((k, stop, depth))
                    depth += end[c] - start[c]
                    k, stop = at[c], at[c + 1]
            elif stack:
                k, stop, depth = stack.pop()
                tour.append(depth)
            else:
                break
        self.rank, self.first = np.empty(n, np.int64), np.empty(n, np.int64)
        self.rank[leaves], self.first[leaves] = np.arange(n), places
        self.minima = [np.array(tour, np.int32)]
        while 2 << (len(self.minima) - 1) <= len(tour):
            half, low = 1 << (len(self.minima) - 1), self.minima[-1]
            self.minima.append(np.minimum(low[:-half], low[half:]))

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and at j, where i and j differ."""
        a, b = np.minimum(self.first[i], self.first[j]), np.maximum(self.first[i], self.first[j])
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level):
            mine = level == k
            low = self.minima[k]
            out[mine] = np.minimum(low[a[mine]], low[b[mine] - (1 << int(k))])
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """Of each place the next one of smaller rank, or the end."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(parts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(part, start, length, period) of all runs of the parts, in this order; one pair of trees."""
    symbols, row = np.unique(np.concatenate(parts), return_inverse=True)
    # separators are smaller than all words, each another one
    cells, k = [], 0
    for c, p in enumerate(parts):
        cells += [row[k : k + len(p)] + len(parts), [c]]
        k += len(p)
    text = np.concatenate(cells).astype(np.int64)
    n = len(text)
    ahead, back = SuffixTree(text.tolist()), SuffixTree([*text[-2::-1].tolist(), int(text[-1])])
    at = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    found = []
    for rank in (ahead.rank, -ahead.rank):
        i = np.arange(n)
        p = np.array(_next_smaller(rank.tolist())) - i
        part = np.searchsorted(at, i, "right") - 1
        # the second copy of the root starts within the part, which can hold a run of this period
        ok = (i + p < at[part + 1] - 1) & (TIMES * p < at[part + 1] - at[part])
        i, p, part = i[ok], p[ok], part[ok]
        right = ahead.extension(i, i + p) if len(i) else np.zeros(0, np.int64)
        # the place before i is n - 1 - i in the reversal, which lacks the last separator
        left = np.zeros(len(i), np.int64)
        inner = i > 0
        left[inner] = back.extension(n - 1 - i[inner], n - 1 - i[inner] - p[inner])
        start, length = i - left, left + p + right
        long = length >= np.maximum(LEAST, TIMES * p)
        found.append(np.stack([part, start - at[part], length, p], 1)[long])
    return [tuple(r) for r in np.unique(np.concatenate(found), axis=0).tolist()]


def periodic_runs(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Of each document (a list of words) the runs (start, length, period), in order."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    where: list[tuple[int, int]] = []
    parts: list[np.ndarray] = []
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    held = 0

    def close() -> None:
        nonlocal held
        if parts:
            for part, start, length, period in runs_of(parts):
                doc, offset = where[part]
                out[doc].append((offset + start, length, period))
        where.clear()
        parts.clear()
        ids.clear()
        held = 0

    for d, words in enumerate(documents):
        # words of one hash count as one here, which can only leave more in a stretch
        own = stretches(np.fromiter(map(hash, words), np.int64, len(words)))
        if held + sum(e - s for s, e in own) > TOGETHER:
            close()
        for s, e in own:
            where.append((d, s))
            parts.append(np.fromiter(map(ids.__getitem__, words[s:e]), np.int64, e - s))
            held += e - s
    close()
    for found in out:
        found.sort()
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: those of a run after its first period go."""
    if not runs:
        return words
    ends = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        ends[start + period] += 1
        ends[start + length] -= 1
    return [w for w, depth in zip(words, np.cumsum(ends[:-1]).tolist(), strict=True) if not depth]


def with_runs(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with n_words, runs (start, length, period; by start, then period) and the collapsed text.

    Words are what white space of ASCII parts, numbered from 0; ``collapsed`` has those that no run
    repeats, joined by a space. Names that ``keep`` uses already get an underscore in front.
    """
    names = name_apart(docs.select(*keep), "n_words", "runs", "collapsed")
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(run)), T.StructField(names[2], T.StringType())])
    n_keep, arrow = len(keep), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.cumsum([len(x) if x else 0 for x in whole.column(n_keep).cast(pa.large_binary()).to_pylist()])
            # some megabytes of text at once
            cuts = [0, *(np.flatnonzero(np.diff(size // (4 << 20))) + 1).tolist(), whole.num_rows] if whole.num_rows else [0, 0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                batch = whole.slice(a, b - a)
                words = [x.split() if x else [] for x in batch.column(n_keep).cast(pa.large_binary()).to_pylist()]
                runs = periodic_runs(words)
                left = [b" ".join(collapsed(w, r)) for w, r in zip(words, runs, strict=True)]
                cells = [*(batch.column(k) for k in range(n_keep)), pa.array([len(w) for w in words], pa.int64()), pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], arrow), pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cells, [f"c{k}" for k in range(len(cells))])

    source = name_apart(docs.select(*keep), "words_of")[0]
    return docs.select(*keep, docs[text].alias(source)).mapInArrow(find, schema)
