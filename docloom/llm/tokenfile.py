"""Token-ID output: concatenated ids with Elias-Fano document boundaries.

A token file is a folder of Parquet rows, so that any store that Spark reaches can hold it and
the job commit decides which tasks' output counts. A row is a block of documents:

    shard, block          place in the order of doc_id (shards are ranges, blocks follow each other)
    first                 ids of the shard before the block
    n_docs, n_ids         documents and ids in the block
    n_nulls, id_base      documents without doc_id, which come first, and the smallest doc_id of the rest
    id_low_bits, id_low, id_high, id_samples    Elias-Fano code of the other doc_ids less id_base
    width, ids            2 or 4 bytes for an id; the ids of all documents, little-endian
    low_bits, low, high   Elias-Fano code of the document ends: low_bits lower bits of each packed,
                          the rest as unary gaps in a bit vector
    samples               position in ``high`` of every 64th set bit (select)

The start of a document is the ids of earlier shards (one number a shard) + first + the end of the
document before it in the block, which select() gives without unpacking the others. Null and empty
texts hold the end id only. Repeated doc_ids keep a row each, in the order of their texts' hash; null
doc_ids come first. Texts of any length are written whole; an empty table gives an empty file. Other
columns, of any name, are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_IDS, SAMPLE = 1 << 20, 64
SCHEMA = "shard long, block int, first long, n_docs int, n_ids long, n_nulls int, id_base long, id_low_bits int, id_low binary, id_high binary, id_samples binary, width int, ids binary, low_bits int, low binary, high binary, samples binary"


class EliasFano:
    """A rising sequence of integers in about 2 + log2(top / n) bits each, with select."""

    def __init__(self, low_bits: int, low: bytes, high: bytes, samples: bytes, n: int):
        self.low_bits, self.n = low_bits, n
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.packbits(((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8), bitorder="little").tobytes() if bits else b""
        places = (values >> bits) + np.arange(n)
        marks = np.zeros((int(places[-1]) + 1) if n else 0, np.uint8)
        marks[places] = 1
        return cls(bits, low, np.packbits(marks, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes(), n)

    def parts(self) -> tuple[int, bytes, bytes, bytes]:
        return self.low_bits, self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << b
        return out

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample before it."""
        place = int(self.samples[i // SAMPLE])
        if i % SAMPLE:
            at, size = place >> 3, 64
            skip, left = place & 7, i % SAMPLE
            while True:
                bits = np.unpackbits(self.high[at : at + size], bitorder="little")
                ones = np.flatnonzero(bits[skip:])
                if len(ones) > left:
                    place = (at << 3) + skip + int(ones[left])
                    break
                size *= 2
        return ((place - i) << self.low_bits) | int(self._low(np.array([i]))[0])

    def select_all(self, i: np.ndarray) -> np.ndarray:
        """The values of rising positions i: the bits between their first and last sample are read once."""
        if not len(i):
            return np.zeros(0, np.int64)
        first = int(i[0]) // SAMPLE
        at = int(self.samples[first]) >> 3
        after = int(i[-1]) // SAMPLE + 1
        end = (int(self.samples[after]) >> 3) + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at:end], bitorder="little")) + (at << 3)
        ones = ones[np.searchsorted(ones, int(self.samples[first])) :]
        return ((ones[i - first * SAMPLE] - i) << self.low_bits) | self._low(i)

    def below(self, value: int) -> int:
        """How many values are smaller, by bisection with select()."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            if self.select(mid) < value:
                low = mid + 1
            else:
                high = mid
        return low

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((places - i) << self.low_bits) | self._low(i)


class Encoder:
    """Ids of whole texts by the tokenizers library, with a cache of the chunks between spaces.

    For a byte-level model (no normalizer, GPT-2 pattern) a token never crosses the place before the
    last space ahead of a word, nor that between a run of Latin letters and ASCII punctuation. So
    the library is asked once a chunk, and its model directly for runs of letters. Texts with
    spaces in a row are cut by a pattern that keeps white space together; those with the control
    characters on which definitions of white space differ, and all texts of other models, go to the
    library whole.
    """

    PIECES = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\s!-/:-@\[-`{-~]|\Z)|\s*\S+?(?=\s|\Z)|\s+")
    PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
    SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]{1,40})([!-/:-@\[-`{-~]*)\Z")
    ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]")
    #: Entries of each of the four tables, with keys of at most LONGEST characters: some 80 MB each.
    CACHE, LONGEST = 400_000, 48

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        plain = all(not (x["lstrip"] or x["rstrip"] or re.search(r"\s|\A[A-Za-z]|[A-Za-z]\Z", x["content"])) for x in spec.get("added_tokens", []))
        self.cut = plain and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.model = self.tokenizer.model
        # the byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes for 256 and up
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        alphabet, more = {}, 256
        for b in range(256):
            alphabet[b] = chr(b if b in visible else more)
            more += b not in visible
        self.letters = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(32, 256)}
        self.space, self.odd = self.letters[32], False
        self.known: tuple[dict, dict] = ({}, {})  # chunks at the start of a text, and those after a space
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}  # after a space

    def _bytes(self, ids) -> bytes:
        cells = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            cells.byteswap()
        return cells.tobytes()

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if self.PLAIN.match(piece):
                found = self._bytes([t.id for t in self.model.tokenize(piece.translate(self.letters))])
            else:
                found = self._whole(piece)
            if len(piece) <= self.LONGEST:
                if len(self.pieces) > self.CACHE:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def _cut(self, text: str) -> bytes | None:
        """None: the text around must go to the library whole."""
        if self.ODD.search(text):
            return None
        return b"".join(map(self._piece, self.PIECES.findall(text)))

    def _chunk(self, chunk: str, after_space: bool) -> bytes | bool:
        simple = self.SIMPLE.match(chunk) if after_space else None
        if simple:  # letters, and perhaps punctuation
            word, tail = simple.groups()
            found = self.words.get(word)
            if found is None:
                found = self._bytes([t.id for t in self.model.tokenize(self.space + (word if word.isascii() else word.translate(self.letters)))])
                if len(self.words) > self.CACHE:
                    self.words.clear()
                self.words[word] = found
            if tail:
                found += self._piece(tail)
        else:
            found = self._cut(" " + chunk if after_space else chunk)
            if found is None:
                found, self.odd = False, True
        if len(chunk) <= self.LONGEST:
            known = self.known[after_space]
            if len(known) > self.CACHE:
                known.clear()
            known[chunk] = found
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian integers of ``width`` bytes."""
        if not self.cut:
            return [self._bytes(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out, later = [], self.known[1]
        for text in texts:
            chunks = text.split(" ")
            if "" in chunks:
                found = self._cut(text)
                out.append(self._whole(text) if found is None else found)
                continue
            cells = list(map(later.get, chunks))
            cells[0] = self.known[0].get(chunks[0])
            if None in cells:
                cells = [self._chunk(c, i > 0) if x is None else x for i, (c, x) in enumerate(zip(chunks, cells, strict=True))]
            out.append(self._whole(text) if self.odd and False in cells else b"".join(cells))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Encode docs(doc_id, text) and write a token file in ascending order of doc_id."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = slim.repartitionByRange(spread, "doc_id", F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end, first, block = enc._bytes([end_id]), 0, 0
        ids: list[bytes] = []
        names: list[int | None] = []
        size, lowest = 0, None  # ids, and the first doc_id, of the block

        def row() -> pa.RecordBatch:
            lengths = np.array([len(x) // enc.width for x in ids], np.int64)
            low_bits, low, high, samples = EliasFano.of(np.cumsum(lengths)).parts()
            known = [x for x in names if x is not None]
            base = known[0] if known else 0
            id_parts = dict(zip(("id_low_bits", "id_low", "id_high", "id_samples"), EliasFano.of(np.array([x - base for x in known], np.int64)).parts(), strict=True))
            cells = {"shard": shard, "block": block, "first": first, "n_docs": len(ids), "n_ids": int(lengths.sum()), "n_nulls": len(ids) - len(known), "id_base": base, **id_parts, "width": enc.width, "ids": b"".join(ids), "low_bits": low_bits, "low": low, "high": high, "samples": samples}
            return pa.RecordBatch.from_pylist([cells], schema)

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                for name, found in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    # ids of a block lie within 62 bits of each other
                    if name is not None:
                        lowest = name if lowest is None else lowest
                        if name - lowest >= 1 << 62:
                            yield row()
                            first, block, size, lowest = first + size, block + 1, 0, name
                            ids.clear()
                            names.clear()
                    ids.append(found + end)
                    names.append(name)
                    size += len(ids[-1]) // enc.width
                    if size >= block_ids:
                        yield row()
                        first, block, size, lowest = first + size, block + 1, 0, None
                        ids.clear()
                        names.clear()
        if ids:
            yield row()

    empty = docs.sparkSession.createDataFrame([], SCHEMA)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(empty.schema)
    ranged.mapInArrow(blocks, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a token file with ``start``: the ids of all documents before the block."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    # one number a shard, and shards are tasks of the writing job: a bounded table
    totals = sorted((r["shard"], r["n"]) for r in rows.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    base = np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()
    starts = spark.createDataFrame([(s, int(b)) for (s, _), b in zip(totals, base, strict=False)], "shard long, shard_start long")
    return rows.join(F.broadcast(starts), "shard").withColumn("start", F.col("shard_start") + F.col("first"))


def _codes(x: dict) -> tuple[EliasFano, EliasFano]:
    ends = EliasFano(x["low_bits"], x["low"], x["high"], x["samples"], x["n_docs"])
    return ends, EliasFano(x["id_low_bits"], x["id_low"], x["id_high"], x["id_samples"], x["n_docs"] - x["n_nulls"])


PARTS = ["start", "n_docs", "n_nulls", "id_base", "id_low_bits", "id_low", "id_high", "id_samples", "low_bits", "low", "high", "samples"]


def documents_of(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of read_tokens()."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = {k: batch.column(i)[r].as_py() for i, k in enumerate(batch.schema.names)}
                code, names = _codes(x)
                ends = code.select_all(np.arange(x["n_docs"]))
                starts = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(x["ids"], "<u2" if x["width"] == 2 else "<u4").astype("<u4")
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                names = np.concatenate([np.zeros(x["n_nulls"], np.int64), names.select_all(np.arange(names.n)) + x["id_base"]])
                names = pa.array(names, mask=np.arange(x["n_docs"]) < x["n_nulls"])
                yield pa.RecordBatch.from_arrays([names, pa.array(starts + x["start"]), pa.array(ends - starts), pa.array(np.array(sums, np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select(*PARTS, "width", "ids").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def offsets_of(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens) of the documents with a doc_id of wanted(doc_id), by select in their blocks alone; no ids are read.

    Repeated doc_ids give a row each; null ones are not looked up.
    """
    # one number a shard, and shards are tasks of the writing job: a bounded table
    spans = sorted((r["first"], r["shard"]) for r in blocks.filter("n_docs > n_nulls").groupBy("shard").agg(F.min("id_base").alias("first")).collect())
    froms, shards = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
    ids = wanted.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("_want")).distinct()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # shards are ranges of doc_id: an id lies in the last one that starts before it, or in any that start with it
        for batch in batches:
            want = np.asarray(batch.column(0))
            low, high = np.maximum(np.searchsorted(froms, want, "left") - 1, 0), np.searchsorted(froms, want, "right")
            n = np.maximum(high - low, 0)
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(shards[at]), pa.array(np.repeat(want, n))], ["shard", "_want"])

    shard = ids.mapInArrow(near, "shard long, _want long")
    lists = shard.groupBy("shard").agg(F.array_sort(F.collect_list("_want")).alias("_wanted"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = {k: batch.column(i)[r].as_py() for i, k in enumerate(batch.schema.names)}
                ends, names = _codes(x)
                out = []
                for want in x["_wanted"]:
                    at = names.below(want - x["id_base"]) if names.n else 0
                    while at < names.n and names.select(at) == want - x["id_base"]:
                        k = at + x["n_nulls"]
                        begin = ends.select(k - 1) if k else 0
                        out.append((want, begin + x["start"], ends.select(k) - begin))
                        at += 1
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["doc_id", "start", "n_tokens"])

    return blocks.join(lists, "shard").select(*PARTS, "_wanted").mapInArrow(rows, "doc_id long, start long, n_tokens long")
