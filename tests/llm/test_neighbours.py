"""The neighbour graphs: recall against brute force, exact scores, copies, and odd rows."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import neighbours, queries

SMALL = "/root/testdata/sf0.001"


def plain(rows: list[tuple], k: int = 5) -> dict:
    """Of each query row (numbered) its k best of all other rows."""
    ok = [(i, d, np.array(x) / max(map(abs, x))) for i, (d, x) in enumerate(rows) if x and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    cos = lambda a, b: float(a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)))
    out = {}
    for i, d, x in ok:
        if d is not None and d % 50 == 0:
            near = [(-round(cos(x, y), 12), e is None, e or 0) for j, e, y in ok if j != i and len(x) == len(y)]
            out[i] = (d, sorted(near)[:k])
    return out


def got_of(df) -> list:
    by: dict = {}
    for r in df.collect():
        by.setdefault(r["query_id"], []).append((r["rank"], -round(r["score"], 12), r["vec_id"] is None, r["vec_id"] or 0))
    return sorted((q, sorted(x)) for q, x in by.items())


def want_of(rows) -> list:
    by: dict = {}
    for d, near in plain(rows).values():
        by.setdefault(d, []).extend((n + 1, *x) for n, x in enumerate(near))
    return sorted((q, sorted(x)) for q, x in by.items() if x)


def test_recall_and_scores_of_the_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = {q: x for q, x in got_of(queries.op12_neighbours(spark, SMALL))}
    want = {q: x for q, x in want_of(rows)}
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    score = {(q, y[3]): y[1] for q, x in want.items() for y in x}
    hits = [(q, y[3]) for q, x in got.items() for y in x if (q, y[3]) in score]
    assert len(hits) >= 0.9 * len(score)
    assert all(abs(y[1] - score[q, y[3]]) < 1e-9 for q, x in got.items() for y in x if (q, y[3]) in score)


def test_recall_over_many_shards(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 24)) + np.repeat(rng.normal(size=(40, 24)) * 2, 100, 0)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = neighbours.build_index(df, 5, shard=600)
    assert index.count() == 7 and index.agg(F.sum("n")).first()[0] == 4000
    got = neighbours.search(index, df.filter("vec_id % 50 = 0"), 5).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    s = unit[::50] @ unit.T
    s[np.arange(80), np.arange(80) * 50] = -2
    best = {(50 * q, int(v)) for q in range(80) for v in np.argsort(-s[q])[:5]}
    assert len(got) == 400 and len({(r["query_id"], r["vec_id"]) for r in got} & best) >= 0.9 * 400


def test_rerank_of_the_pruning_rule():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    edges, entries = neighbours.graph(x)
    far = lambda a, b: math.sqrt(max(0.0, 2 - 2 * float(x[a] @ x[b])))
    at = np.arange(5, dtype=np.int32)
    near = np.broadcast_to(np.arange(300, dtype=np.int32), (5, 300))
    for p, row in zip(at, neighbours.pruned(x, at, near), strict=True):
        kept: list[int] = []
        for c in sorted((c for c in range(300) if c != p), key=lambda c: far(p, c)):
            if len(kept) < neighbours.DEGREE and all(neighbours.ALPHA * far(k, c) > far(p, c) for k in kept):
                kept.append(c)
        assert kept == [c for c in row.tolist() if c >= 0]
    seen, open_ = {*entries.tolist()}, entries.tolist()
    while open_:
        new = {c for c in edges[open_.pop()].tolist() if c >= 0} - seen
        seen |= new
        open_ += new
    assert len(seen) == 300


def test_recall_beside_a_dense_cluster():
    """Thousands of near copies in one place lead no search astray, and their own neighbours are found."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2400, 32))
    x[:1000] = x[0] + 0.1 * rng.normal(size=(1000, 32))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    edges, entries = neighbours.graph(x)
    q = np.arange(0, 2400, 20)
    s = x[q] @ x.T
    best, got = np.argsort(-s, 1)[:, :6], neighbours.beam(x, edges, entries, x[q], neighbours.WIDE)[0]
    assert np.mean([len({*a.tolist()} & {*b.tolist()}) / 6 for a, b in zip(best, got, strict=True)]) >= 0.97
    seen, open_ = {*entries.tolist()}, entries.tolist()
    while open_:
        new = {c for c in edges[open_.pop()].tolist() if c >= 0} - seen
        seen |= new
        open_ += new
    assert len(seen) == 2400


def test_copies_ties_and_odd_rows(spark):
    rng = random.Random(4)
    v = lambda n=3: [rng.uniform(-2, 3) for _ in range(n)]
    rows = [(0, [1.0, 2.0, 3.0]), (50, [1.0, 2.0, 3.0]), (50, [1.0, 2.0, 3.0]), (50, [3.0, 1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (None, None), (100, None), (150, []), (200, [0.0, 0.0, 0.0]), (250, [1.0, None, 2.0]), (300, [1.0, float("nan"), 2.0]), (350, [float("inf"), 1.0, 1.0]), (400, [1.0, 2.0]), (1, [2.0, 4.5]), (450, [1e300, 2e300, 3.5e300]), (2, [1e-300, 2e-300, 4e-300]), (2**63 - 1, [1.0, 2.0, 3.0])]
    rows += [(k, [1.0, 2.0, 3.0]) for k in range(500, 560)] + [(k, v()) for k in range(600, 660)] + [(700, [5.0])]
    df = spark.createDataFrame([(d, x, "n", 1) for d, x in rows], "vec_id long, embedding array<double>, dim string, ids int")
    found = neighbours.nearest(df, lambda c: c % 50 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert got_of(found) == want_of(rows)
    none = df.limit(0)
    assert neighbours.nearest(none, lambda c: c % 50 == 0).collect() == []
