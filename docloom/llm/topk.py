"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors become integers floor(256 x). For each vector the mean and deviation of its segments are
kept at several resolutions; with segment length n, |q - v|^2 >= sum n ((mq - mv)^2 + (sq - sv)^2),
and so q.v <= sum n (mq mv + sq sv). Blocks of queries meet blocks of candidates; from coarse to
fine, pairs whose bound stays below the query's k-th best score so far are dropped, and the
survivors get exact 64-bit integer products. A query starts with the k-th best score within its
own block, which are real candidates. Only pairs that cannot be among the k best are dropped.
Vectors so large that 64 bits could overflow stand in blocks of their own and get exact products of
any size, without bounds; they rank by these, and the 64-bit score stops at its limits.

Vectors that are null or hold null, NaN or infinite components take no part, nor do vectors of
another length than the query's. Repeated vec_ids are rows of their own; a row is no candidate of
itself. Ties go to the smaller vec_id. Null vec_ids are never queries; as candidates they come last.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import kept, written

QUERY_BLOCK, BLOCK, LARGE_BLOCK, SEND_BYTES = 512, 8192, 256, 64 << 20
LARGEST = np.iinfo(np.int64).max


def quantized(column: pa.Array) -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]:
    """Valid rows by vector length and by whether they are large: (rows, integers), or (rows, the components as they are) of large ones."""
    flat = column.flatten() if column.null_count == 0 else column.fill_null(pa.scalar([], column.type)).flatten()
    sizes = np.diff(np.asarray(column.offsets)) if column.null_count == 0 else np.array([0 if not x.is_valid else len(x) for x in column])
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")), np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = {}
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        x = values[starts[rows][:, None] + np.arange(n)]
        ok = np.isfinite(x).all(1)
        # two vectors within the bound have a product below 2^62
        large = ~(np.abs(x).max(1) < 2.0**22 / np.sqrt(n))
        for big in (False, True):
            mine = ok & (large == big)
            if mine.any():
                out[int(n), big] = (rows[mine], x[mine] if big else np.floor(x[mine] * 256).astype(np.int64))
    return out


def exact(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as integers of any size."""
    whole = lambda v: math.floor(v * 256) if abs(v) < 2.0**1000 else int(v) * 256
    return np.array([whole(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def _order_of(score: int) -> bytes | None:
    """Bytes that sort as the integers do, for those beyond 62 bits."""
    if abs(score) < 1 << 62:
        return None
    size = (abs(score).bit_length() + 7) // 8
    cells = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return b"\x01" + cells if score > 0 else b"\x00" + bytes(255 - c for c in cells)


def search_large(q: np.ndarray, q_key: np.ndarray, v: np.ndarray, v_id: np.ndarray, v_key: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """As search(), with Python's integers and without bounds."""
    found: tuple[list[int], list[int], list[int]] = ([], [], [])
    for a in range(len(q)):
        scores = (v * q[a]).sum(1)
        best = sorted((b for b in range(len(v)) if v_key[b] != q_key[a]), key=lambda b: (-scores[b], v_id[b], v_key[b]))[:k]
        for into, x in zip(found, ([a] * len(best), best, [int(scores[b]) for b in best]), strict=True):
            into += x
    return found


def _levels(n: int) -> list[int]:
    """Numbers of segments, coarse to fine."""
    return [s for s in (2, 8, 16) if s < n] or [1]


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(n) mean and sqrt(n) deviation of each segment, so that a bound is one matrix product."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    n = np.diff(edges)
    sums = np.add.reduceat(x, edges[:-1], 1) / n
    squares = np.add.reduceat(x * x, edges[:-1], 1) / n
    return np.concatenate([sums, np.sqrt(np.maximum(squares - sums * sums, 0))], 1) * np.tile(np.sqrt(n), 2)


def _best(rows: np.ndarray, ids: np.ndarray, keys: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each row's k best: higher score, smaller id, smaller key."""
    order = np.lexsort((keys, ids, -scores, rows))
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, int)
    rank = np.arange(len(rows)) - np.repeat(first, np.diff([*first, len(rows)]))
    return order[rank < k]


def search(q: np.ndarray, q_key: np.ndarray, v: np.ndarray, v_id: np.ndarray, v_key: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best of the block, where they may count."""
    found_q, found_v, found_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(q) or not len(v):
        return found_q, found_v, found_s
    qf, vf = q.astype(np.float64), v.astype(np.float64)
    slack = 1e-9 * (np.linalg.norm(qf, axis=1).max() * np.linalg.norm(vf, axis=1).max() + 1) + 1e-3
    levels = _levels(q.shape[1])
    rows = cols = None
    for i, segments in enumerate(levels):
        sq, sv = _statistics(qf, segments), _statistics(vf, segments)
        if i == 0:
            rows, cols = np.nonzero(sq @ sv.T >= (floor - slack)[:, None])
        else:
            ok = np.concatenate([np.einsum("ij,ij->i", sq[rows[a : a + 65536]], sv[cols[a : a + 65536]]) for a in range(0, max(1, len(rows)), 65536)]) >= floor[rows] - slack
            rows, cols = rows[ok], cols[ok]
    other = q_key[rows] != v_key[cols]
    rows, cols = rows[other], cols[other]
    scores = np.concatenate([np.einsum("ij,ij->i", q[rows[a : a + 65536]], v[cols[a : a + 65536]]) for a in range(0, max(1, len(rows)), 65536)])
    ok = scores >= floor[rows]
    rows, cols, scores = rows[ok], cols[ok], scores[ok]
    best = _best(rows, v_id[cols], v_key[cols], scores, k)
    return rows[best], cols[best], scores[best]


def _packed(df: DataFrame, size: int, k: int = 0) -> DataFrame:
    """Rows (block, dim, n, ids, keys, mat, floor) of at most ``size`` vectors of one length, within each task; width 0: large ones."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple[int, bool], list] = {}

        def row(kind: tuple[int, bool]) -> pa.RecordBatch:
            ids, keys, mats = (np.concatenate(x) for x in zip(*open_.pop(kind), strict=True))
            floor = np.full(len(ids), np.iinfo(np.int64).min + 1, np.int64)
            narrow = mats
            if not kind[1]:
                if k and len(ids) > k:
                    scores = mats @ mats.T
                    np.fill_diagonal(scores, np.iinfo(np.int64).min + 1)
                    floor = np.partition(scores, len(ids) - k, 1)[:, len(ids) - k]
                narrow = mats.astype(np.int16) if np.abs(mats).max(initial=0) < 1 << 15 else mats
            width = 0 if kind[1] else narrow.itemsize
            return pa.RecordBatch.from_pydict({"dim": pa.array([kind[0]], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "width": pa.array([width], pa.int32()), "ids": [ids.astype("<i8").tobytes()], "keys": [keys.astype("<i8").tobytes()], "mat": [narrow.tobytes()], "floor": [floor.astype("<i8").tobytes()]})

        for batch in batches:
            ids, keys = (np.asarray(batch.column(i).fill_null(LARGEST)) for i in (0, 1))
            for kind, (rows, x) in quantized(batch.column(2)).items():
                most = min(size, LARGE_BLOCK) if kind[1] else size
                for a in range(0, len(rows), most):
                    part = open_.setdefault(kind, [])
                    part.append((ids[rows[a : a + most]], keys[rows[a : a + most]], x[a : a + most]))
                    if sum(len(y[0]) for y in part) >= most:
                        yield row(kind)
        for kind in list(open_):
            yield row(kind)

    return df.mapInArrow(pack, "dim int, n int, width int, ids binary, keys binary, mat binary, floor binary")


def _unpacked(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    width = row[f"{side}width"]
    mat = np.frombuffer(row[f"{side}mat"], {0: np.float64, 2: np.int16, 8: np.int64}[width]).reshape(row[f"{side}n"], row[f"{side}dim"])
    return (*(np.frombuffer(row[f"{side}{x}"], "<i8") for x in ("ids", "keys")), exact(mat) if width == 0 else mat.astype(np.int64), np.frombuffer(row[f"{side}floor"], "<i8"))


def top_k(vectors: DataFrame, is_query: Callable, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row for which is_query(vec_id) holds."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    # a row's own key: vec_id, and its number among rows of that vec_id
    keyed = written(rows.withColumn("key", F.xxhash64("id", F.row_number().over(W.partitionBy("id", F.xxhash64("x")).orderBy("x")), "x")).select("id", "key", "x"), "vectors")
    candidates = kept(_packed(keyed, BLOCK))
    queries = kept(_packed(keyed.filter(F.col("id").isNotNull() & is_query(F.col("id"))), QUERY_BLOCK, k))
    left = candidates.select([F.col(c).alias(f"v_{c}") for c in candidates.columns])
    right = queries.select([F.col(c).alias(f"q_{c}") for c in queries.columns])
    size = queries.agg(F.sum(F.length("mat") + 24 * F.col("n"))).first()[0] or 0
    if size <= SEND_BYTES:
        pairs = left.join(F.broadcast(right), left.v_dim == right.q_dim)
    else:  # blocks of queries are dealt to every group of candidate blocks
        groups = max(1, candidates.count() // 64)
        pairs = left.withColumn("g", F.pmod(F.xxhash64("v_keys"), F.lit(groups))).join(right.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))), "g").filter("v_dim = q_dim").drop("g")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                v_id, v_key, v, _ = _unpacked(row, "v_")
                q_id, q_key, q, floor = _unpacked(row, "q_")
                if object in (q.dtype, v.dtype):
                    a, b, s = search_large(q.astype(object), q_key, v.astype(object), v_id, v_key, k)
                    order = [_order_of(x) for x in s]
                    s = np.array([min(max(x, -LARGEST), LARGEST) for x in s], np.int64)
                    a, b = np.array(a, np.int64), np.array(b, np.int64)
                else:
                    a, b, s = search(q, q_key, v, v_id, v_key, floor, k)
                    order = [None] * len(s)
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (q_id[a], q_key[a], v_id[b], v_key[b], s)), pa.array(order, pa.binary())], ["q", "q_key", "v", "v_key", "s", "large"])

    found = pairs.mapInArrow(compare, "q long, q_key long, v long, v_key long, s long, large binary")
    # a score beyond 62 bits is above or below all others, by its sign, and its bytes have its place among its like
    sign = F.when(F.col("large").isNull(), 0).otherwise(F.signum("s").cast("int"))
    rank = F.row_number().over(W.partitionBy("q", "q_key").orderBy(sign.desc(), F.desc("large"), F.desc("s"), "v", "v_key"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select(F.col("q").alias("query_id"), "rank", F.when(F.col("v") != LARGEST, F.col("v")).alias("vec_id"), F.col("s").alias("score"))
