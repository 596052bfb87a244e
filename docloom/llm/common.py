"""What the operators of this subpackage share: table paths, shared storage, byte-level words.

Texts are handled as UTF-8 bytes in numpy: a slice of an Arrow batch is one byte buffer plus
row offsets, so a task's memory is bounded by ``SLICE_BYTES`` (or by one text, if longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.scratch import kept, scratch, shared_dir, table, written  # noqa: F401

#: Bytes of text that a task handles at once.
SLICE_BYTES = 2 << 20


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of a batch; a null text is empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
        yield at, end, data[ends[at] : ends[end]], ends[at : end + 1] - ends[at]
        at = end


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a word where punctuation separates: ASCII letters and digits, and all of other scripts.
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 4096)
        for k, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray, alnum: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (ASCII lower case) of all rows, and each row's first word, with the end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _ALNUM[data] if alnum else ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    first[offsets[full]] = inside[offsets[full]]
    last[offsets[full + 1] - 1] = inside[offsets[full + 1] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), np.searchsorted(starts, offsets)


def ngrams(words: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams at every word, and whether each lies within one row."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = words[:size].copy()
    for k in range(1, n):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[k : k + size]
    rest = np.zeros(len(words) + 1, np.int64)
    rest[firsts[:-1]] = 1
    row = np.cumsum(rest[: len(words)])
    return mix(h), row[:size] == row[n - 1 :]


def name_apart(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that the table does not use."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def hash_share(*columns) -> F.Column:
    """0 <= x < 2^31, spread evenly by the columns' values."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 31))
