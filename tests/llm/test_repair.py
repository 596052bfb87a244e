"""Conversation repair: integers against plain search, segments against whole conversations, the query against SQL and odd rows."""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from compare import connection, differences
from docloom.llm import queries, repair

SMALL = "/root/testdata/sf0.001"
PATTERN = re.compile(r"(s?(ua)+)?")


def plain(cells: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, audit) of the best edits of rows (initial, fault), by strings."""

    @functools.cache
    def best(i: int, state: str, inserted: int) -> tuple[int, str]:
        out = [(0, "")] if i == len(cells) and state in ("", "a") else []
        step = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        if inserted < 3:
            c, a = best(i, step, inserted + 1)
            out.append((c + 5, "I" + a))
        if i < len(cells):
            initial, fault = cells[i]
            more = 5 * (fault == "truncated")
            moves = [(2, "D", state)]
            if fault not in ("blank", "duplicate"):
                moves.append((1 + more, "R", step))
                if initial == step or initial == "s" and state == "":
                    moves.append((more, "K", initial))
            for cost, letter, to in moves:
                c, a = best(i + 1, to, 0)
                out.append((c + cost, letter + a))
        return min(out, default=(10**9, ""))

    return best(0, "", 0)


def listed(cells: list[tuple[str, str]]) -> tuple[int, str]:
    """The same by every sequence of edits of few rows."""
    found = []
    for n in range(2 * len(cells) + 1):
        for letters in itertools.product("DIKR", repeat=n):
            if sum(c != "I" for c in letters) != len(cells):
                continue
            options, cost, k = [""], 0, 0
            for c in letters:
                if c == "I":
                    cost, add = cost + 5, "ua"
                else:
                    initial, fault = cells[k]
                    k += 1
                    if c == "D":
                        cost += 2
                        continue
                    if fault in ("blank", "duplicate"):
                        options = []
                    cost += (c == "R") + 5 * (fault == "truncated")
                    add = initial if c == "K" else "ua"
                options = [o + x for o in options for x in add]
            if any(PATTERN.fullmatch(o) for o in options):
                found.append((cost, "".join(letters)))
    return min(found)


def test_plain_search_is_what_all_sequences_give():
    kinds = [("u", ""), ("a", ""), ("s", ""), ("u", "truncated"), ("t", ""), ("a", "blank")]
    for n in range(4):
        for cells in itertools.product(kinds, repeat=n):
            assert plain(list(cells)) == listed(list(cells))


def test_integers_and_segments():
    rng = random.Random(6)
    for _ in range(400):
        cells = [(rng.choice("uuuaaast"), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randint(1, 14))]
        cost, audit = plain(cells)
        cuts = sorted(rng.sample(range(1, len(cells)), min(len(cells) - 1, rng.randint(0, 4))))
        parts = [cells[a:b] for a, b in zip([0, *cuts], [*cuts, len(cells)], strict=True)]
        got_cost, got_audit, states, tail = repair.combined([repair.segment_paths(p) for p in parts])
        assert (got_cost, got_audit) == (cost, audit)
        rows, at = [], 0
        for part, (a, b) in zip(parts, states, strict=True):
            own = repair.segment_paths(part)[a, b][1]
            rows += repair.repaired([("user" if i == "u" else i, i, "x.") for i, _ in part], own + (tail if at == len(parts) - 1 else ""), a)
            at += 1
        assert PATTERN.fullmatch("".join(r[0] for r, _ in rows))


@pytest.fixture
def odd():
    rows = [(1, 0, "user", "a."), (1, 1, "assistant", "b!"), (1, 1, "assistant", "b!"), (1, 3, "user", None), (1, None, "system", "s."), (1, None, None, "x"), (2, 5, "tool", "t? "), (2, 9, "user", " . \x0b"), (3, None, None, None), (None, 1, "user", "who."), (None, 2, "assistant", "me."), (None, None, "assistant", "me."), (5, 0, "", "empty role."), (5, 1, "user", "é\n\n.\n"), (6, 7, "user", ""), (7, 1, "system", "only.")]
    rows += [(8, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(700)] + [(8, 300, "user", "again.")] * 650 + [(9, t, "user", "same.") for t in range(600)]
    rows += [(k, t, r, x) for k in range(20, 60) for t, (r, x) in enumerate([("system", "s."), ("user", "q?"), ("assistant", "a."), ("user", "q?"), ("assistant", "b")])]
    return rows


def whole(rows) -> list[tuple]:
    """The contract, row by row."""
    by: dict = {r[0]: [] for r in rows}
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        k = zlib.crc32(f"{c if c is not None else ' '}:{t if t is not None else ' '}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        by[c] += [(t is not None, t or 0, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = []
    for c, own in by.items():
        own.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        cells, seen = [], set()
        for _, _, role, text in own:
            left = re.sub(r"[\x20\x09-\x0D]+", "", text)
            cells.append((role[:1], "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else ""))
            seen.add((role, text))
        parts = [cells[a : a + 50] for a in range(0, len(cells), 50)]
        cost, audit = plain(cells) if len(cells) < 200 else repair.combined([repair.segment_paths(p) for p in parts])[:2]
        done = repair.repaired([(r[2], r[2][:1], r[3]) for r in own], audit, repair.NONE)
        turns = [r[1] for r in own if r[0]]
        n = lambda f: sum(x[1] == f for x in cells)  # noqa: B023, E731
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(cells))
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows_and_long_conversations(spark, odd, tmp_path):
    df = spark.createDataFrame([(*r, 1, "x") for r in odd], "conv_id long, turn long, role string, text string, part int, digest string")
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == whole(odd)
    cut = repair.segments(repair.damaged(df)).select("conv_id", "copies").collect()
    assert max(sum(r["copies"]) for r in cut) <= repair.ROWS and sum(r["conv_id"] == 8 for r in cut) >= 3
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.op13_conversation_repair(spark, f"{tmp_path}/none").collect() == []


def test_the_sql(spark, odd, tmp_path):
    import duckdb

    assert differences(queries.op13_conversation_repair(spark, SMALL), connection(SMALL), queries.ORACLE_SQL["op13_conversation_repair"]) is None
    few = [r for r in odd if r[0] not in (8, 9)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", few)
    assert sorted(con.execute(queries.ORACLE_SQL["op13_conversation_repair"]).fetchall(), key=str) == whole(few)
