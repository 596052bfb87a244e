"""Periodic runs against brute force, on literal, random and odd rows, and the whole query."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from docloom.llm import periodic, queries

SMALL = "/root/testdata/sf0.001"


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    """Every stretch of equal words p apart, for each p, that is long enough and has no smaller period."""
    out = []
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            part = w[s : i + p]
            if len(part) >= max(6, 4 * p) and all(any(part[k] != part[k + q] for k in range(len(part) - q)) for q in range(1, p)):
                out.append((s, len(part), p))
    return sorted(out)


def plain_digest(doc_id, text) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_random_rows_of_few_words():
    rng, rows = random.Random(1), []
    for _ in range(400):
        k = rng.choice([1, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            root = [rng.randrange(k + 2) for _ in range(rng.randint(1, 6))]
            at = rng.randint(0, len(w))
            w[at:at] = (root * 12)[: rng.randint(3, 40)]
        rows.append(w)
    assert periodic.periodic_runs(rows) == [plain_runs(w) for w in rows]


def test_extensions_of_the_tree():
    rng = random.Random(2)
    s = [rng.randrange(1, 3) for _ in range(120)] + [0]
    import numpy as np

    tree = periodic.SuffixTree(s)
    pairs = [(i, j) for i in range(121) for j in range(121) if i != j]
    want = [next(k for k in range(122) if max(i, j) + k >= 121 or s[i + k] != s[j + k]) for i, j in pairs]
    i, j = (np.array(x) for x in zip(*pairs, strict=True))
    assert tree.extension(i, j).tolist() == want
    assert tree.rank.tolist() == np.argsort(sorted(range(121), key=lambda k: s[k:])).tolist()


def test_odd_rows(spark):
    long = " ".join(f"w{i % 700} x{i % 11}" for i in range(30_000))
    texts = [None, "", " ", "a a a a a a", "a a a a a", "ab " * 4, "x y " * 3 + "x y", "a\tb\nc " * 5, "日 本 " * 9 + "é", "a\xa0b " * 8, long, "q " * 5000, "q " * 5000]
    rows = [(i, x, 1) for i, x in enumerate(texts)] + [(None, "z z z z z z z", 2), (7, None, 3)]
    got = periodic.with_runs(spark.createDataFrame(rows, "runs long, text string, collapsed int"), ["runs", "collapsed"]).collect()
    assert len(got) == len(rows)
    key = lambda x: str(x)
    want = []
    for i, text, c in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain_runs(w) if text != long else [(0, 60_000, 15_400)] if len(w) >= 4 * 15_400 else []
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        want.append((i, c, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted(((r["runs"], r["collapsed"], r["n_words"], [tuple(x) for x in r["_runs"]], r["_collapsed"]) for r in got), key=key) == sorted(want, key=key)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.with_runs(none, ["doc_id"]).collect() == []


def test_the_whole_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, SMALL).collect()]
    assert sorted(got) == sorted(plain_digest(r["doc_id"], r["text"]) for r in docs)
    assert sum(r[1] for r in got) > 10


def test_the_query_on_odd_rows(spark, tmp_path):
    rows = [(None, "a a a a a a a", "x"), (None, None, None), (3, None, "x"), (4, "", "y"), (5, "one", "y"), (5, "one", "y"), *((i, "a b c d e f g h i j", "z") for i in range(100, 160))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((plain_digest(r[0], r[1]) for r in rows), key=str)
