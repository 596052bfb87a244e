"""Token counts by prefix dynamic programming over a byte-pair vocabulary.

For every prefix of a text the encoding's last token and token count are stored: the last token of
prefix i is the one vocabulary piece t ending at i that may follow the last token of the prefix
before t, and count[i] = count[i - len(t)] + 1. Two tokens may follow each other if merging their
joined text gives just these two. Counts of any prefix, the longest prefix within a budget and the
tokens left of a cut are then look-ups, without encoding again.

Texts fall into units that no piece crosses (a run of word starts with what follows, and line
breaks), so tables are made once a distinct unit and added up along the text. That holds for the
vocabularies this reads: sentencepiece BPE models with identity normalisation, byte fallback, no
user-defined pieces, and no piece with a word start after another character; others are refused.

A null text is empty (0 tokens). Every text is counted whole, however long; repeated rows are counted
each. Columns may have any names. A worker's tables are bounded by numbers of entries of short strings
(CACHE, PAIRS) and start anew when full.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import name_apart

MARK = "▁"


class PrefixCounter:
    UNITS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
    CACHE, PAIRS, LONGEST = 200_000, 400_000, 64

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        sp = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        kinds = {p.type for p in model.pieces}
        usual = pb.ModelProto.SentencePiece
        text = {p.piece: p.score for p in model.pieces if p.type == usual.NORMAL}
        norm = model.normalizer_spec
        if kinds & {usual.USER_DEFINED, usual.UNUSED} or model.trainer_spec.model_type != pb.TrainerSpec.BPE or norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not model.trainer_spec.byte_fallback or any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in text):
            raise ValueError("not a sentencepiece BPE model of the kind that the prefix tables cover")
        self.library, self.scores = sp, text
        self.pairs: dict[str, dict] = {}
        self.n_pairs = 0
        # every ending of a piece: 1 if it is a piece itself, else 0
        self.endings = {p[k:]: 0 for p in text for k in range(1, len(p))} | {p: 1 for p in text}
        self.known: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def merged(self, text: str) -> list[str]:
        """Best pair first, leftmost of equals: for the short strings on which two tokens are tried."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, after: dict, t: str) -> bool:
        """May t follow the token whose table this is (the first table: stand at the start)?"""
        a = after.get(None)
        self.n_pairs += 1
        ok = after[t] = self.merged(t) == [t] if a is None else self.merged(a + t) == [a, t]
        return ok

    def prefix_counts(self, unit: str) -> list[int]:
        """Tokens of unit[:i] for i = 0 .. len(unit)."""
        if self.n_pairs > self.PAIRS:
            self.pairs, self.n_pairs = {}, 0
        endings, pairs = self.endings, self.pairs
        after, count = [pairs.setdefault("", {})], [0]  # what may follow the last token of each prefix
        for i in range(1, len(unit) + 1):
            j = i - 1
            t = unit[j]
            cost = endings.get(t)
            if not cost:  # a character without a piece is its bytes, or else only the end of longer pieces
                cost, known = len(t.encode("utf-8", "surrogatepass")), cost is not None
            else:
                known = True
            while True:
                if cost:
                    ok = after[j].get(t)
                    if ok is None:
                        ok = self.follows(after[j], t)
                    if ok:
                        break
                j -= 1
                if j < 0 or not known:
                    raise AssertionError(f"no token ends {unit[:i]!r}")
                t = unit[j:i]
                cost = endings.get(t)
                if cost is None:
                    raise AssertionError(f"no token ends {unit[:i]!r}")
            count.append(count[j] + cost)
            nxt = pairs.get(t)
            if nxt is None:
                nxt = pairs[t] = {None: t}
            after.append(nxt)
        return count

    def units(self, text: str) -> list[str]:
        return self.UNITS.findall(MARK + text.replace(" ", MARK)) if text else []

    def count(self, unit: str) -> int:
        n = self.known.get(unit)
        if n is None:
            n = self.prefix_counts(unit)[-1]
            if len(unit) <= self.LONGEST:
                if len(self.known) > self.CACHE:
                    self.known.clear()
                self.known[unit] = n
        return n

    def _chunk(self, chunk: str) -> int:
        n = sum(map(self.count, self.units(chunk)))
        if len(chunk) <= self.LONGEST:
            if len(self.chunks) > self.CACHE:
                self.chunks.clear()
            self.chunks[chunk] = n
        return n

    def total(self, text: str) -> int:
        """Tokens of the text: by the chunks between spaces, each of which starts units of its own."""
        if not text:
            return 0
        chunks = text.split(" ")
        if "" in chunks or MARK in text:
            return sum(map(self.count, self.units(text)))
        found = list(map(self.chunks.get, chunks))
        if None in found:
            found = [self._chunk(c) if n is None else n for c, n in zip(chunks, found, strict=True)]
        return sum(found)

    def table(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for i = 0 .. len(text)."""
        out, before = [np.zeros(1, np.int64)], 0
        for k, u in enumerate(self.units(text)):
            counts = np.array(self.prefix_counts(u), np.int64)
            out.append(before + (counts[2:] if k == 0 else counts[1:]))  # the mark before the text is not a character of it
            before += int(counts[-1])
        return np.concatenate(out)

    def cut(self, text: str, limit: int) -> int:
        """UTF-8 bytes of the longest prefix (whole characters) of at most ``limit`` tokens."""
        units = self.units(text)
        counts = np.cumsum([0, *map(self.count, units)])
        k = int(np.searchsorted(counts, limit, "left")) - 1  # the last unit that starts under the limit
        if k < 0:
            return 0
        if k >= len(units):
            return len(text.encode("utf-8", "surrogatepass"))
        inside = self.prefix_counts(units[k])
        i = max(i for i, c in enumerate(inside) if counts[k] + c <= limit)
        chars = max(0, sum(map(len, units[:k])) + i - 1)  # less the mark that stands before the text
        return len(text[:chars].encode("utf-8", "surrogatepass"))


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def with_counts(docs: DataFrame, model: str, columns: list[str], limit: int = 4096) -> DataFrame:
    """The given columns with n_bytes, n_tokens, over_limit and limit_bytes (what a cut at ``limit`` tokens keeps)."""
    source = docs.select(*columns, F.coalesce("text", F.lit("")).alias(name_apart(docs, "_count_text")[0]))
    more = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("limit_bytes", T.LongType())]
    schema = T.StructType([*docs.select(*columns).schema.fields, *more])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = part.column(part.num_columns - 1).to_pylist()
                sizes = [len(x.encode("utf-8", "surrogatepass")) for x in texts]
                n = [c.total(x) for x in texts]
                cuts = [s if k <= limit else c.cut(x, limit) for x, s, k in zip(texts, sizes, n, strict=True)]
                arrays = [pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array(cuts, pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], schema.names)

    return source.mapInArrow(count, schema)


def prefix_tables(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, counts): token counts of every prefix, as one entry a character (little-endian 32 bits).

    counts[i] is the tokens of the first i characters, from 0 to the whole text.
    """

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 50):
                part = batch.slice(i, 50)
                cells = [c.table(x).astype("<u4").tobytes() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cells, pa.binary())], ["doc_id", "counts"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(tables, "doc_id long, counts binary")
