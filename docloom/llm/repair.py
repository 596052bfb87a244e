"""Repair of conversation structure: the cheapest edits that make roles read ``(s?(ua)+)?``, by integers.

A row's first fault counts: blank, duplicate (role and text seen earlier), truncated (the last character
that is no white space is none of ``.!?``). Edits: Keep 0, Rerole to user or assistant 1, Delete 2
(required for blank and duplicate rows), Insert an empty user or assistant row 5; a truncated row that
stays costs 5 more. An edit's weight is one integer: high digits carry its cost, below them stand the
letters of the audit in places of fixed width, zeros after the last. The smallest integer over the paths
of a graph (rows times states of the role pattern) is so the cheapest repair, and of those the one whose
audit sorts first.

A conversation may be a third of all rows: rows are sorted over all tasks by (conversation, turn, role,
text), and a task cuts what it holds of a conversation into segments of at most ROWS rows. A segment's
matrix has the smallest integer for each pair of states before and after it. Both ends of such a path
are rows, so no audit begins another of the segment, and the matrices of a conversation combine from
its end to its start with the rank of the rest as one more low digit: again an ordinary minimum. The
segments' states chosen, each segment is repaired by itself, and its text goes to the conversation's
digest in order; only that hash is sequential, over bytes that stream by.

Null roles and texts read as one space; null turns come first. Rows of one turn are in the order of role
and text. Equal rows are one row with a number of copies until a segment writes its letters. Conversations
may have any number of rows, none after damage too; a null conversation is one like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from docloom.llm.common import written

#: Rows and bytes of a segment (copies of a row count), at most; and of a piece of text on its way to the digest.
ROWS, BYTES, PIECE = 512, 1 << 20, 64 << 10
#: Role patterns so far: nothing, s, .. u, .. a; of each the state that an initial leads to.
NONE, SYSTEM, USER, ASSISTANT = range(4)
STEPS = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: Digits of the audit's letters: their order is that of ASCII; zero ends an audit.
DIGIT, BITS = {"D": 1, "I": 2, "K": 3, "R": 4}, 3
LETTERS = {d: c for c, d in DIGIT.items()}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Rows inserted one after another: a third would come back to a state. What completes each state at the end.
MOST_INSERTS = 2
TAILS = {NONE: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
SPACE, WHOLE = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as the contract damages them, by crc32(conv_id:turn) % 20; null cells read as one space there."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(cell("conv_id"), F.lit(":"), cell("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", cell("role").alias("role"), cell("text").alias("text"), k.alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("k <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _edits(initial: str, fault: str, state: int) -> list[tuple[int, str, int]]:
    """(cost, letter, next state) of the edits of one row in a state."""
    out = [(DELETE, "D", state)]
    if fault not in ("blank", "duplicate"):
        more = CUT if fault == "truncated" else 0
        if initial in STEPS[state]:
            out.append((KEEP + more, "K", STEPS[state][initial]))
        out += [(REROLE + more, "R", to) for role, to in STEPS[state].items() if role != "s"]
    return out


def segment_paths(rows: list[tuple[str, str]]) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> (cost, audit) of the best edits of rows (initial, fault) that end with a row's edit."""
    width = BITS * (1 + MOST_INSERTS) * len(rows)
    low = (1 << width) - 1

    def behind(cost: int, name: str, rest: dict[int, int], best: dict[int, int]) -> None:
        """Paths that begin with an edit: its letter takes the first place, those of the rest move one on."""
        first = (cost << width) + (DIGIT[name] << width - BITS)
        for end, w in rest.items():
            w = first + (w & ~low) + ((w & low) >> BITS)
            if end not in best or w < best[end]:
                best[end] = w

    best: list[dict[int, int]] = [{s: 0} for s in range(4)]
    for initial, fault in reversed(rows):
        row: list[dict[int, int]] = [{} for _ in range(4)]
        for state in range(4):
            for cost, name, to in _edits(initial, fault, state):
                behind(cost, name, best[to], row[state])
        best = row
        for _ in range(MOST_INSERTS):
            more = [dict(x) for x in row]
            for state in range(4):
                for role, to in STEPS[state].items():
                    if role != "s":
                        behind(INSERT, "I", best[to], more[state])
            best = more
    return {(s, e): (w >> width, _audit(w & low, width)) for s in range(4) for e, w in best[s].items()}


def _audit(digits: int, width: int) -> str:
    out = []
    for place in range(width - BITS, -1, -BITS):
        d = digits >> place & 7
        if not d:
            break
        out.append(LETTERS[d])
    return "".join(out)


def _number(audit: str, letters: int) -> int:
    """An audit as digits of a fixed number of places."""
    out = 0
    for c in audit:
        out = out << BITS | DIGIT[c]
    return out << BITS * (letters - len(audit))


def combined(paths: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, str, list[tuple[int, int]], str]:
    """(cost, audit, (state before, after) of each segment, audit of the rows inserted after the last one)."""
    cost = {s: INSERT * len(t) for s, t in TAILS.items()}
    rank = {s: len(t) for s, t in TAILS.items()}  # the places of their order
    chosen: list[dict[int, int]] = []
    for path in reversed(paths):
        letters = max(len(a) for _, a in path.values())
        low = BITS * letters + 2
        weigh = lambda s, e: ((path[s, e][0] + cost[e]) << low) + (_number(path[s, e][1], letters) << 2) + rank[e]  # noqa: B023, E731
        now = {s: min((weigh(s, e), e) for e in range(4) if (s, e) in path) for s in range(4)}
        order = sorted({w & ((1 << low) - 1) for w, _ in now.values()})
        cost = {s: w >> low for s, (w, _) in now.items()}
        rank = {s: order.index(w & ((1 << low) - 1)) for s, (w, _) in now.items()}
        chosen.append({s: e for s, (_, e) in now.items()})
    states, audit, at = [], [], NONE
    for path, to in zip(paths, reversed(chosen), strict=True):
        states.append((at, to[at]))
        audit.append(path[at, to[at]][1])
        at = to[at]
    return cost[NONE], "".join(audit) + TAILS[at], states, TAILS[at]


def repaired(rows: list[tuple[str, str, str]], audit: str, before: int) -> list[tuple[str, str]]:
    """(role, text) of rows (role, initial, text) after an audit that starts in a state; inserted rows may come last."""
    # in a state at most one of user and assistant can follow, but for what is kept
    follows = lambda s: "a" if s == USER else "u"
    names = {"u": "user", "a": "assistant"}
    out, state, k = [], before, 0
    for c in audit:
        if c == "I":
            role, text = names[follows(state)], ""
        else:
            role, initial, text = rows[k]
            k += 1
            if c == "D":
                continue
            if c == "K":
                out.append((role, text))
                state = STEPS[state][initial]
                continue
            role = names[follows(state)]
        out.append((role, text))
        state = STEPS[state][role[0]]
    return out


SEGMENT = "conv_id {kind}, part int, segment int, roles array<string>, texts array<string>, copies array<bigint>, faults array<string>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, turns bigint, first_turn {turn}, last_turn {turn}, paths array<struct<before:int,after:int,cost:bigint,audit:string>>"


def segments(rows: DataFrame) -> DataFrame:
    """Rows(conv_id, turn, role, text) in order, as segments with their faults and paths (see SEGMENT)."""
    kinds = dict(rows.dtypes)
    digest = F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = rows.groupBy(F.col("conv_id").alias("c"), digest.alias("d")).agg(F.min(turn).alias("first"))
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("digest", digest)
    met = same.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    last = F.regexp_extract("text", rf"({WHOLE}){SPACE}*\z", 1)
    fault = F.when(~F.col("text").rlike(WHOLE), "blank").when(turn != F.col("first"), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    laid = met.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault")).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = SEGMENT.format(kind=kinds["conv_id"], turn=kinds["turn"])
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size, conv = TaskContext.get().partitionId(), 0, [], 0, None

        def row() -> dict:
            turns = [r[0] for r in held if r[0] is not None]
            again = {"duplicate": 0, "blank": 0, "truncated": 0, "": 0}
            cells, illegal, before = [], 0, None
            for _, role, text, copies, fault in held:
                initial = role[:1]
                again[fault] += 1
                again[fault if fault == "blank" else "duplicate"] += copies - 1
                illegal += (before is not None and before + initial not in ("su", "ua", "au")) + (copies - 1) * (initial + initial not in ("su", "ua", "au"))
                before = initial
                cells += [(initial, fault)] + [(initial, fault if fault == "blank" else "duplicate")] * (copies - 1)
            paths = [{"before": s, "after": e, "cost": c, "audit": a} for (s, e), (c, a) in sorted(segment_paths(cells).items())]
            return {"conv_id": conv, "part": part, "segment": number, "roles": [r[1] for r in held], "texts": [r[2] for r in held], "copies": [r[3] for r in held], "faults": [r[4] for r in held], **{c: again[c] for c in ("blank", "duplicate", "truncated")}, "illegal": illegal, "first": held[0][1][:1], "last": before, "turns": len(set(turns)), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "paths": paths}

        out: list[dict] = []
        for batch in batches:
            for own, at, role, text, copies, fault in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                while copies:
                    n = sum(r[3] for r in held)
                    if held and (own != conv or n >= ROWS or size + len(text) > BYTES):
                        out.append(row())
                        number, held, size, n = number + 1, [], 0, 0
                        if len(out) >= 64:
                            yield pa.RecordBatch.from_pylist(out, arrow)
                            out = []
                    conv = own
                    take = min(copies, ROWS - n)
                    held.append((at, role, text, take, fault))
                    size += len(text)
                    copies -= take
                    fault = fault if fault == "blank" else "duplicate"
        if held:
            out.append(row())
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return written(laid.mapInArrow(cut, schema), "segments")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit; the repaired text in pieces).

    The pieces (conv_id, part, segment, piece, content) make up ``role:text`` lines in this order, each
    segment's joined by newlines; ``content`` of the first piece of a segment that has lines is not preceded by a newline.
    """
    kinds = dict(rows.dtypes)
    cut = segments(rows)
    narrow = cut.drop("roles", "texts", "copies", "faults")

    def solved_rows(seg: list[dict]) -> list[dict]:
        cost, audit, states, tail = combined([{(p["before"], p["after"]): (p["cost"], p["audit"]) for p in s["paths"]} for s in seg])
        illegal, turns, before, lows, highs = 0, 0, None, [], []
        for k, s in enumerate(seg):
            illegal += s["illegal"] + (k > 0 and seg[k - 1]["last"] + s["first"] not in ("su", "ua", "au"))
            if s["first_turn"] is not None:
                turns += s["turns"] - (before == s["first_turn"])
                before = s["last_turn"]
                lows.append(s["first_turn"])
                highs.append(s["last_turn"])
        whole = {"gaps": highs[-1] - lows[0] + 1 - turns if lows else 0, **{c: sum(s[c] for s in seg) for c in ("blank", "duplicate", "truncated")}, "illegal": illegal, "cost": cost, "audit": audit}
        out = [{"conv_id": s["conv_id"], "part": s["part"], "segment": s["segment"], "before": a, "after": b} for s, (a, b) in zip(seg, states, strict=True)]
        out[0] |= whole
        out[-1]["tail"] = tail
        return out

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                if held and r["conv_id"] != held[0]["conv_id"]:
                    out += solved_rows(held)
                    held = []
                held.append(r)
            yield pa.RecordBatch.from_pylist(out, solved_arrow)
        if held:
            yield pa.RecordBatch.from_pylist(solved_rows(held), solved_arrow)

    solved = f"conv_id {kinds['conv_id']}, part int, segment int, before int, after int, tail string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
    solved_arrow = to_arrow_schema(_parse_datatype_string(solved))
    done = written(narrow.repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment").mapInArrow(solve, solved), "repairs")
    found = done.filter("audit is not null").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    states = done.select("part", "segment", "before", "after", "tail")
    texts = cut.select("conv_id", "part", "segment", "roles", "texts", "copies", "paths").join(states, ["part", "segment"])
    pieces = f"conv_id {kinds['conv_id']}, part int, segment int, piece int, content binary"
    pieces_arrow = to_arrow_schema(_parse_datatype_string(pieces))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                r = {c: batch.column(j)[i].as_py() for j, c in enumerate(names)}
                audit = next(p["audit"] for p in r["paths"] if (p["before"], p["after"]) == (r["before"], r["after"])) + (r["tail"] or "")
                full = [(role, role[:1], text) for role, text, n in zip(r["roles"], r["texts"], r["copies"], strict=True) for _ in range(n)]
                text = "\n".join(f"{role}:{text}" for role, text in repaired(full, audit, r["before"])).encode()
                if text:
                    cells = [text[a : a + PIECE] for a in range(0, len(text), PIECE)]
                    yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], "part": r["part"], "segment": r["segment"], "piece": k, "content": c} for k, c in enumerate(cells)], pieces_arrow)

    return found, texts.select("conv_id", "part", "segment", "roles", "texts", "copies", "paths", "before", "after", "tail").mapInArrow(lines, pieces)


def digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired texts in pieces: segments joined by newlines, hashed as they stream by."""
    kind = dict(pieces.dtypes)["conv_id"]
    order = ["conv_id", "part", "segment", "piece"]
    laid = pieces.repartition("conv_id").sortWithinPartitions(*order)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, hasher = None, None
        for batch in batches:
            own, out = [], []
            for c, piece, content in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if hasher is None or c != conv:
                    if hasher is not None:
                        own.append(conv)
                        out.append(hasher.hexdigest())
                    conv, hasher = c, hashlib.sha256()
                elif piece == 0:
                    hasher.update(b"\n")
                hasher.update(content.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(own, batch.schema.types[0]), pa.array(out, pa.string())], ["conv_id", "repaired_sha256"])
        if hasher is not None:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], batch.schema.types[0]), "repaired_sha256": [hasher.hexdigest()]})

    return laid.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def repairs(rows: DataFrame, all_ids: DataFrame) -> DataFrame:
    """The repair of each conversation of all_ids(conv_id), one row each; zeros, no audit and the hash of nothing where no row is left."""
    found, pieces = repair(rows)
    ids = all_ids.select("conv_id").distinct()
    out = ids
    for k, t in enumerate((found, digests(pieces))):
        t = t.withColumnRenamed("conv_id", f"_id{k}")
        out = out.join(t, F.col("conv_id").eqNullSafe(F.col(f"_id{k}")), "left").drop(f"_id{k}")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))

