"""Secret scans with a trigram inverted index.

Every rule's regular expression is parsed, and a Boolean query of trigrams derived from it that the
text of any match satisfies (``trigram_query``): a sequence needs all its parts, a choice one of
them, and the short strings that a part may stand for are the choice of these. A slice of texts is
indexed by trigram (only the rules' trigrams have postings), the postings are intersected and united
as the query says, and only the candidate texts are verified with the regular expression. A rule from
which no trigram follows scans all texts.

Spans are (kind, start, end) in code points, end exclusive, leftmost and non-overlapping a kind.
The first three kinds are the base; the others add spans. A null text is empty and has none. Texts of
any length are scanned whole, repeated rows each; columns may have any names but ``secrets``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import _LOWER, name_apart, text_slices


_parser = re._parser  # the standard library's parser of expressions


def _either(word: str) -> str:
    """Letters in either case, of ASCII only."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


MOST_STRINGS, MOST_CLASS = 64, 16


def _joined(a: set[bytes], b: set[bytes]) -> set[bytes]:
    return {x + y for x in a for y in b}


def _all_of(parts: list):
    """The conjunction of queries, of which None says nothing."""
    parts = [p for p in parts if p is not None]
    return ("and", parts) if parts else None


def _any_of(parts: list):
    return None if not parts or any(p is None for p in parts) else ("or", parts)


def _of_strings(strings: set[bytes]):
    """One of the strings stands in the text."""
    return _any_of([_all_of(sorted({x[i : i + 3] for i in range(len(x) - 2)})) for x in sorted(strings)])


def _class_strings(items) -> set[bytes] | None:
    """The lower-case strings that a class of characters stands for; None: too many."""
    out: set[bytes] = set()
    for op, arg in items:
        if op is _parser.LITERAL:
            out.add(_low(arg))
        elif op is _parser.RANGE and arg[1] - arg[0] < MOST_STRINGS:
            out |= {_low(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
        if len(out) > MOST_CLASS:
            return None
    return out


def _low(c: int) -> bytes:
    return bytes(_LOWER[list(chr(c).encode("utf-8", "surrogatepass"))])


def _walk(items) -> tuple[set[bytes] | None, object]:
    """(the strings that this part of an expression stands for, if few; a query that its matches satisfy)."""
    whole: set[bytes] | None = {b""}  # all strings of the part so far
    run, found = {b""}, []  # strings of the run of known parts that ends here
    for op, arg in items:
        more, query, ends = None, None, False
        if op is _parser.LITERAL:
            more = {_low(arg)}
        elif op is _parser.IN:
            more = _class_strings(arg)
        elif op is _parser.SUBPATTERN:
            if not arg[1] & re.IGNORECASE:
                more, query = _walk(arg[3])
        elif op is _parser.BRANCH:
            sides = [_walk(side) for side in arg[1]]
            more = None if any(s is None for s, _ in sides) else set().union(*[s for s, _ in sides])
            query = _any_of([q if s is None else _of_strings(s) for s, q in sides])
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
            least, most, part = arg
            once, inside = _walk(part)
            if once is not None and most <= 3:
                more = set()
                for k in range(least, most + 1):
                    times = {b""}
                    for _ in range(k):
                        times = _joined(times, once)
                    more |= times
            elif least:
                # the first time follows what stands before, and what stands after is not next to it
                more, query, ends = once, inside, True
        elif op is _parser.AT:
            more = {b""}
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = _joined(run, more)
        else:
            found += [_of_strings(run), query, _of_strings(more) if more is not None else None]
            run = {b""} if more is None or len(more) > MOST_STRINGS else more
        if more is None or ends or whole is None or len(whole) * len(more) > MOST_STRINGS:
            whole = None
        else:
            whole = _joined(whole, more)
        if ends:
            found.append(_of_strings(run))
            run = {b""}
    return whole, _all_of([*found, _of_strings(run)])


def trigram_query(pattern: re.Pattern):
    """("and" | "or", parts) over trigrams in ASCII lower case; None: nothing must stand in the text."""
    if pattern.flags & re.IGNORECASE:  # other letters than ASCII may match there
        return None
    return _walk(_parser.parse(pattern.pattern, pattern.flags))[1]


def grams_of(query) -> set[bytes]:
    return set() if query is None else {query} if isinstance(query, bytes) else set().union(*map(grams_of, query[1]))


def holds(query, text: bytes) -> bool:
    """Does a text (in ASCII lower case) satisfy the query?"""
    if query is None:
        return True
    return query in text if isinstance(query, bytes) else (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


class Rule:
    """A kind of secret: matches of which ``group`` has at least ``least`` characters."""

    def __init__(self, kind: str, pattern: str, least: int = 0, group: int = 0):
        self.kind, self.pattern, self.least, self.group = kind, re.compile(pattern), least, group
        self.query = trigram_query(self.pattern)
        #: Of a pattern that is one repeated class of ASCII: the class, whose long runs are all that can match.
        self.one_class = None
        parsed = list(_parser.parse(pattern))
        if len(parsed) == 1 and parsed[0][0] is _parser.MAX_REPEAT and parsed[0][1][1] is _parser.MAXREPEAT and not group:
            part = list(parsed[0][1][2])
            if len(part) == 1 and part[0][0] is _parser.IN and all(op in (_parser.LITERAL, _parser.RANGE) for op, _ in part[0][1]):
                chars = [c for c in range(128) if re.fullmatch(pattern, chr(c) * max(1, parsed[0][1][0]))]
                if all((arg if op is _parser.LITERAL else arg[1]) < 128 for op, arg in part[0][1]):
                    self.one_class = np.zeros(256, bool)
                    self.one_class[chars] = True

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.pattern.finditer(text) if len(m[self.group]) >= self.least]


_KEYS = "|".join([*map(_either, ("password", "passwd", "secret", "token")), f"{_either('api')}_?{_either('key')}"])
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
    Rule("private", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    # where a token begins, so that a long run of its letters is read once
    Rule("bearer", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


class Index:
    """Postings of the rules' trigrams over the texts of a slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, table: np.ndarray):
        self.rows: dict[int, np.ndarray] = {}
        low = _LOWER[data].astype(np.uint32)
        if len(low) < 3:
            return
        grams = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        at = np.flatnonzero(table[grams])
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[row + 1]
        at, row = at[inside], row[inside]
        pairs = np.unique((table[grams[at]].astype(np.int64) << 40) | row)
        names = pairs >> 40
        for k in np.unique(names):
            self.rows[int(k) - 1] = pairs[names == k] & ((1 << 40) - 1)

    def match(self, query) -> np.ndarray:
        if isinstance(query, int):
            return self.rows.get(query, np.zeros(0, np.int64))
        parts = sorted((self.match(q) for q in query[1]), key=len)  # shortest postings first
        out = parts[0]
        for rows in parts[1:]:
            out = np.intersect1d(out, rows, assume_unique=True) if query[0] == "and" else np.union1d(out, rows)
        return out


def _numbered(query, names: list[bytes]):
    return None if query is None else names.index(query) if isinstance(query, bytes) else (query[0], [_numbered(q, names) for q in query[1]])


def with_secrets(docs: DataFrame, columns: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The given columns and ``secrets``, an array of (kind, start, end) by start, then the rules' order."""
    column = name_apart(docs, "_scan_text")[0]
    source = docs.select(*columns, F.col("text").alias(column))
    cell = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField("secrets", cell)])
    names = sorted(set().union(*[grams_of(r.query) for r in rules]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.array([int.from_bytes(g, "big") for g in names], np.int64)
        table = np.zeros(1 << 24, np.uint8 if len(names) < 255 else np.uint16)
        table[wanted] = np.arange(1, len(names) + 1)
        queries = [_numbered(r.query, names) for r in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at, end, data, offsets in text_slices(batch, column):
                index = Index(data, offsets, wanted, table)
                found: dict[int, list[tuple[int, int, int]]] = {}
                texts: dict[int, str] = {}
                for nth, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                    for r in (_scanned(rule, data, offsets) if query is None else index.match(query)).tolist():
                        if r not in texts:
                            texts[r] = data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace")
                        for a, b in rule.spans(texts[r]):
                            found.setdefault(r, []).append((a, nth, b))
                cells = pa.array([[{"kind": rules[n].kind, "start": a, "end": b} for a, n, b in sorted(found.get(r, ()))] for r in range(end - at)], kind)
                yield pa.RecordBatch.from_arrays([*batch.slice(at, end - at).columns[:-1], cells], schema.names)

    return source.mapInArrow(scan, schema)


def _scanned(rule: Rule, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that a rule without mandatory trigrams must verify, after a scan of all bytes."""
    if rule.one_class is None:
        return np.arange(len(offsets) - 1)
    inside = np.concatenate([[False], rule.one_class[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    # a run may reach over the end of a text: a candidate too many, never one too few
    long = edge[1::2] - edge[0::2] >= max(1, rule.least)
    rows = [np.arange(np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")) for a, b in zip(edge[0::2][long].tolist(), edge[1::2][long].tolist(), strict=True)]
    return np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts and hash of the base kinds, and all spans as text."""
    found = with_secrets(docs, ["doc_id"])
    text = lambda cells: F.array_join(F.transform(cells, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE))
    of = lambda k: F.filter("secrets", lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
