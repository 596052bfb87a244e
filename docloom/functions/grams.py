"""Hashed word triples of texts, worked out on the UTF-8 bytes of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are handled at once.
SLICE_BYTES = 2 << 20
_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, SLICE_BYTES + 4096), base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows (in lower case), and each word's row. Words: runs of a-z, 0-9 and U+3400 to U+9FFF."""
    n = len(data)
    lead = (data >= 0xE4) & (data <= 0xE9)
    lead[:-1] |= (data[:-1] == 0xE3) & (data[1:] >= 0x90)
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    inside[2:] |= lead[:-2]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    first[offsets[full]] = inside[offsets[full]]
    last[offsets[full + 1] - 1] = inside[offsets[full + 1] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), np.searchsorted(offsets, starts, "right") - 1


def _triples(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct triples of all rows, in order of row and hash, and how many each row has."""
    n = len(offsets) - 1
    words, row = _words(data, offsets) if len(data) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if len(words) < 3:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    h = mix((words[:-2] * _STEP + words[1:-1]) * _STEP + words[2:]).view(np.int64)
    whole = row[:-2] == row[2:]
    h, row = h[whole], row[:-2][whole]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=n)


def _cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        texts = texts.cast(pa.large_string()).fill_null("")
        # of all other characters, only the dotted I and the Kelvin sign have an ASCII letter in lower case
        for c in "\u0130\u212a":
            if pc.any(pc.match_substring(texts, c)).as_py():
                texts = pc.replace_substring(texts, c, c.lower())
        n = len(texts)
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        values, sizes, at = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
            found, size = _triples(_LOWER[data[ends[at] : ends[end]]], ends[at : end + 1] - ends[at])
            values.append(found)
            sizes.append(size)
            at = end
        yield pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(values)))


def triple_hashes(text: Column) -> Column:
    """64 bits for each distinct run of three words in lower case, in rising order; none of a null text."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _cut(batches)

    # filters on it must not work it out again
    return cut.asNondeterministic()(text)
