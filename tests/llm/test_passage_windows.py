"""Equal minima in text that repeats: which windows stay, and that no diagonal is lost."""

from __future__ import annotations

import random

import numpy as np
import pytest

from docloom.llm import passages


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def brute(h: np.ndarray, t: int) -> set[tuple[int, int, int]]:
    out = set()
    for c in np.flatnonzero(h).tolist():
        l = r = c  # noqa: E741
        while l > 0 and h[l - 1] > h[c]:
            l -= 1  # noqa: E741
        while r + 1 < len(h) and h[r + 1] >= h[c]:
            r += 1
        if r - l + 1 >= t:
            out.add((l, c, r))
    return out


def test_every_window_and_no_run_lost():
    rng = np.random.default_rng(1)
    for k in range(300):
        t = int(rng.integers(2, 12))
        h = rng.integers(k % 2, 30, rng.integers(1, 100)).astype(np.uint64)
        if k % 3 == 0:
            h = np.concatenate([h[:9], np.tile(h[-4:], 8), h])
        lo, c, hi = passages.compact_windows(h, t, every=True)
        assert set(zip(lo.tolist(), c.tolist(), hi.tolist(), strict=True)) == brute(h, t)
        kept = ~passages.same_before(h, lo, c, hi, t)
        runs = lambda ok: {h[s : s + t].tobytes() for l, m, r in zip(lo[ok], c[ok], hi[ok], strict=True) for s in range(max(l, m - t + 1), min(m, r - t + 1) + 1)}  # noqa: B023, E731, E741
        assert runs(kept) == runs(np.ones(len(c), bool))


def after_repeated_line(n: int) -> tuple[list[tuple[int, str]], list[int]]:
    """n pairs of a passage of 55 words, before which one text repeats its first 35; the diagonal of each."""
    rows, right = [], []
    for k in range(n):
        line, rest = words(10 * k + 1, 35), words(10 * k + 2, 20)
        rows.append((2 * k, " ".join([*words(10 * k + 3, 40), *line, *rest, *words(10 * k + 4, 40)])))
        rows.append((2 * k + 1, " ".join([*words(10 * k + 5, 30), *line, *line, *rest, *words(10 * k + 6, 40)])))
        right.append(30 + 35 - 40)
    return rows, right


def test_passage_after_its_own_first_line(spark):
    rows, right = after_repeated_line(400)
    got = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r["doc_id"], r["start_word"] - r["other_start"]) for r in got if r["end_word"] - r["start_word"] >= 55}
    assert [k for k, d in enumerate(right) if (2 * k + 1, d) not in found] == []


def shingles(w: list[str]) -> list[tuple[str, ...]]:
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def alike(a: list[str], b: list[str]) -> bool:
    """By brute force: do any 50 words of a and 50 to 51 words of b have a Jaccard similarity of 0.8?"""
    x, y = shingles(a), shingles(b)
    sets = [set(y[j : j + n]) for n in (46, 47) for j in range(len(y) - n + 1)]
    for i in range(len(x) - 45):
        s = set(x[i : i + 46])
        if any(len(s & t) >= 0.8 * len(s | t) for t in sets):
            return True
    return False


@pytest.mark.parametrize("settle", [1, passages.SETTLE])
def test_edited_passages_of_brute_force_are_in_one_class(spark, monkeypatch, settle):
    """Groups of copies of a passage of 50 to 90 words, each with up to four words changed, put in or left out; by rounds, and settled."""
    monkeypatch.setattr(passages, "SETTLE", settle)
    rng, texts = random.Random(11), []
    for g in range(14):
        base = words(5000 + g, rng.randint(50, 90))
        for k in range(5):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [f"q{rng.randrange(10**6)}"] * rng.randint(0, 1)
            texts.append([*words(6000 + 10 * g + k, rng.randint(3, 30)), *w, *words(8000 + 10 * g + k, rng.randint(3, 30))])
    got = passages.repeated(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for r in got:
        root[find(r["doc_id"])] = find(r["other_id"])
        a, b = texts[r["doc_id"]][r["start_word"] : r["end_word"]], texts[r["other_id"]][r["other_start"] : r["other_end"]]
        x, y = set(shingles(a)), set(shingles(b))
        assert min(len(a), len(b)) >= 50 and len(x & y) >= 0.8 * len(x | y) - 1e-9
    pairs = [(i, j) for g in range(14) for i in range(5 * g, 5 * g + 5) for j in range(5 * g, i) if alike(texts[i], texts[j])]
    lost = [(i, j) for i, j in pairs if find(i) != find(j)]
    assert len(pairs) > 40 and lost == []


def test_a_line_without_a_passage_links_nothing(spark):
    """Texts that share 40 words, of which two share 15 more that the others lack."""
    line, more = words(1, 40), words(2, 15)
    rows = [(i, " ".join([*words(100 + i, 60), *line, *(more if i in (7, 20) else ()), *words(200 + i, 60)])) for i in range(30)]
    got = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} == {(20, 7)}


def test_null_empty_repeated_and_periodic_texts(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "x " * 3000, 0), (4, "x " * 3000, 0), (5, " ".join(words(3, 80)), 0), (5, " ".join(words(3, 80)), 0), (None, " ".join(words(3, 80)), 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    assert {(r["doc_id"], r["other_id"]) for r in passages.repeated(df).collect()} <= {(4, 3)}
    assert passages.repeated(df.limit(0)).count() == 0


def test_membership_and_lacking_shingles_by_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(200):
        x, y = (rng.integers(0, 40, rng.integers(0, 60)).astype("<u4") for _ in range(2))
        assert passages._held(x, y).tolist() == [v in set(y.tolist()) for v in x.tolist()]
        out, c = rng.random(120) < rng.choice([0.0, 0.1, 1.0]), rng.integers(0, 106, 4)
        where = np.flatnonzero(out).tolist()
        for row, at in zip(passages._lacking(out, 14, 5, 50, 6, c).tolist(), c.tolist(), strict=True):
            before = [g for g in reversed(where) if at + 14 - 50 <= g < at][:6]
            after = [g for g in where if at + 14 - 5 < g <= at + 50 - 5][:6]
            assert row == before + [-1] * (6 - len(before)) + after + [-1] * (6 - len(after))


def test_rows_do_not_depend_on_other_documents(spark):
    """Groups that fail their representative, alone and among many others: the same rows."""
    line = [words(700 + g, 40) for g in range(6)]
    rows = [(i, " ".join([*words(100 + i, 60), *line[i % 6], *words(900 + i % 4, 15), *words(200 + i, 60)])) for i in range(48)]
    others = [(1000 + i, " ".join([*words(3000 + i // 3, 90), *words(5000 + i, 30)])) for i in range(600)]
    of = lambda rows: {tuple(r) for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] < 1000}
    alone = of(rows)
    assert len(alone) >= 36 and of(rows + others) == alone


def test_stretch_of_a_long_copy(spark):
    long = words(42, 3000)
    rows = [(1, " ".join(long)), (2, " ".join([*words(43, 100), *long, *words(44, 100)])), (3, " ".join(words(45, 300)))]
    got = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) > 3
    (doc, other, start, end, *of_other), = {tuple(r[c] for c in ("doc_id", "other_id", *passages.STRETCH)) for r in got}
    # a piece at the end may take in as many other words as its similarity allows
    assert (doc, other, of_other) == (2, 1, [0, 3000]) and 0 <= start <= 100 and 3100 <= end <= 3200


def test_stretches_by_brute_force(spark):
    rng, rows = random.Random(3), []
    for pair in range(40):
        for _ in range(rng.randint(1, 12)):
            s, s2, n, n2 = rng.randrange(300), rng.randrange(300), rng.randint(5, 60), rng.randint(5, 60)
            rows.append((pair // 3, -pair, s, s + n, s2, s2 + n2, n, 0.9))
    rows = sorted(set(rows))
    name = {r: i for i, r in enumerate(rows)}
    for _ in rows:
        for x in rows:
            for y in rows:
                if x[:2] == y[:2] and x[2] < y[3] and y[2] < x[3] and x[4] < y[5] and y[4] < x[5]:
                    name[x] = name[y] = min(name[x], name[y])
    of = {i: [r for r in rows if name[r] == i] for i in name.values()}
    bounds = {r: tuple(pick(x[k] for x in of[name[r]]) for k, pick in ((2, min), (3, max), (4, min), (5, max))) for r in rows}
    df = spark.createDataFrame(rows, "doc_id long, other_id long, start_word long, end_word long, other_start long, other_end long, n_words long, similarity double")
    got = passages.in_stretches(df).collect()
    assert sorted(map(tuple, got)) == sorted((*r, *bounds[r]) for r in rows)
    assert passages.in_stretches(df.limit(0)).count() == 0
