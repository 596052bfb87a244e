"""Approximate nearest neighbours by cosine: a directed graph with robust pruning for each shard.

Equal vectors are one node first, with the k + 1 smallest vec_ids that have it, since no query can need
more of them. Nodes are dealt to shards of about SHARD by a hash. Each shard's task builds a graph: nodes
come in growing batches; a greedy search with a beam over the graph so far proposes neighbours, and a
node keeps the nearest of them, then the nearest that no kept one is ALPHA times nearer to than the node
itself, until it has DEGREE edges. The edges are also put in the other way round, and nodes with too many
are pruned by the same rule. A second pass repeats this on the whole graph, searches start at ENTRIES
nodes, and every node is reached from them. Blocks of queries search every shard with a beam; the nodes
of the beam get their exact cosine in double precision on the vectors as they came, and the shards' best
are merged. The index is a written table, one row a shard, so a lost executor costs one shard.

Vectors that are null, empty or zero or hold null, NaN or infinite components take no part, nor do
vectors of another length than the query's. Repeated vec_ids are rows of their own; a row is no candidate
of itself. Ties go to the smaller vec_id, null ones last; a null vec_id is never a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import kept, written

#: Nodes of a shard (about), edges of a node, width of the beams of the build and of searches, relaxation of the pruning rule.
SHARD, DEGREE, BEAM, WIDE, ALPHA = 4096, 32, 64, 192, 1.2
#: Beam entries whose edges are followed at once, nodes where a search starts, points that search together, and a block of queries.
AT_ONCE, ENTRIES, BATCH, QUERY_BLOCK, SEND_BYTES = 4, 32, 512, 512, 64 << 20


def valid(x: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors times a power of two each, which leaves cosines as they are; their lengths)."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x, np.sqrt(np.einsum("ij,ij->i", x, x))


def beam(points: np.ndarray, edges: np.ndarray, entries: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities), best first, of a greedy search for each row of q; node -1 where there are fewer."""
    nodes = np.full((len(q), width), -1, np.int32)
    score = np.full((len(q), width), -np.inf, np.float32)
    followed = np.zeros((len(q), width), bool)
    entries = entries[:width]
    begin = q @ points[entries].T
    order = np.argsort(-begin, 1, kind="stable")
    nodes[:, : len(entries)], score[:, : len(entries)] = entries[order], np.take_along_axis(begin, order, 1)
    seen = np.zeros((len(q), len(points)), bool)
    seen[:, entries] = True
    live = np.arange(len(q))
    while len(live):
        open_ = ~followed[live] & (nodes[live] >= 0)
        some = open_.any(1)
        live, open_ = live[some], open_[some]
        if not len(live):
            break
        take = np.argsort(~open_, 1, kind="stable")[:, :AT_ONCE]
        real = np.take_along_axis(open_, take, 1)
        own = np.take_along_axis(nodes[live], take, 1)
        followed[np.repeat(live, AT_ONCE)[real.ravel()], take.ravel()[real.ravel()]] = True
        near = np.where(real[:, :, None], edges[own], -1).reshape(len(live), -1)
        near.sort(1)
        new = near >= 0
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(new)
        node = near[row, col]
        fresh = ~seen[live[row], node]
        row, col, node = row[fresh], col[fresh], node[fresh]
        seen[live[row], node] = True
        found = np.full(near.shape, -np.inf, np.float32)
        found[row, col] = np.einsum("ij,ij->i", points[node], q[live[row]])
        all_score, all_node = np.concatenate([score[live], found], 1), np.concatenate([nodes[live], near], 1)
        all_done = np.concatenate([followed[live], np.zeros(near.shape, bool)], 1)
        best = np.argsort(-all_score, 1, kind="stable")[:, :width]
        score[live] = np.take_along_axis(all_score, best, 1)
        nodes[live] = np.where(np.isfinite(score[live]), np.take_along_axis(all_node, best, 1), -1)
        followed[live] = np.take_along_axis(all_done, best, 1)
    return nodes, score


def pruned(points: np.ndarray, at: np.ndarray, near: np.ndarray) -> np.ndarray:
    """DEGREE edges or fewer (else -1) of the points ``at`` out of the nodes ``near``, a row each, -1 where there are none."""
    out = np.full((len(at), DEGREE), -1, np.int32)
    for a in range(0, len(at), 256):
        p, c = at[a : a + 256], np.sort(near[a : a + 256], 1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        c[c == p[:, None]] = -1
        x = points[c]
        far = np.where(c >= 0, 2 - 2 * np.matmul(x, points[p][:, :, None])[:, :, 0], np.inf)
        order = np.argsort(far, 1, kind="stable")
        c, far = np.take_along_axis(c, order, 1), np.take_along_axis(far, order, 1)
        x = np.take_along_axis(x, order[:, :, None], 1)
        apart = ALPHA * ALPHA * (2 - 2 * np.matmul(x, x.transpose(0, 2, 1)))
        alive, rows = np.isfinite(far), np.arange(len(p))
        for k in range(DEGREE):
            has = alive.any(1)
            if not has.any():
                break
            pick = alive.argmax(1)
            out[a + rows[has], k] = c[rows, pick][has]
            alive &= apart[rows, pick] > far
            alive[rows, pick] = False
    return out


def graph(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges: nodes or -1 of each point, the nodes where searches start) for points of length 1.

    Two passes over the points: the second one searches the whole graph. Nodes that no path reaches then get
    an edge from the nearest that has one, so rows may be a little wider than DEGREE.
    """
    n = len(points)
    middle = int(np.argmax(points @ points.mean(0)))
    edges = np.full((n, DEGREE), -1, np.int32)
    order = np.random.default_rng(1).permutation(n)
    order = np.concatenate([[middle], order[order != middle]]).astype(np.int32)

    def put(new: np.ndarray, near: np.ndarray) -> None:
        edges[new] = pruned(points, new, near)
        # the other way round
        src, dst = np.repeat(new, DEGREE), edges[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, (to, first, count) = src[by], np.unique(dst[by], return_index=True, return_counts=True)
        for low, high in ((0, 8), (8, 64), (64, n)):
            mine = (count > low) & (count <= high)
            if mine.any():
                slot = np.arange(count[mine].max())
                more = np.where(slot < count[mine][:, None], src[np.minimum(first[mine][:, None] + slot, len(src) - 1)], -1)
                edges[to[mine]] = _joined(points, to[mine], edges[to[mine]], more)

    done = 0
    while done < n:
        new = order[done : done + min(BATCH, max(128, done // 4))]
        near = beam(points, edges, order[: min(done, ENTRIES)], points[new], BEAM)[0] if done else np.zeros((len(new), 0), np.int32)
        if done < 2 * BATCH:  # while there are few, those of the batch see each other too
            near = np.concatenate([near, np.broadcast_to(new, (len(new), len(new)))], 1)
        put(new, near)
        done += len(new)
    entries = order[:ENTRIES]
    for a in range(0, n, BATCH):
        new = order[a : a + BATCH]
        put(new, np.concatenate([beam(points, edges, entries, points[new], BEAM)[0], edges[new]], 1))
    return _reached(points, edges, entries), entries


def _reached(points: np.ndarray, edges: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The edges and further ones, so that paths lead from the entries to every node."""
    n = len(points)
    found = np.zeros(n, bool)
    open_ = entries
    more: dict[int, list[int]] = {}
    while True:
        while len(open_):
            found[open_] = True
            near = np.unique(edges[open_])
            open_ = near[(near >= 0) & ~found[near]]
        left = np.flatnonzero(~found)
        if not len(left):
            break
        # some at once: the nearest reached node of each gets an edge, and what they lead to is reached as well
        left = left[:BATCH]
        have = np.flatnonzero(found)
        for node, k in zip(left.tolist(), (points[left] @ points[have].T).argmax(1).tolist(), strict=True):
            more.setdefault(int(have[k]), []).append(node)
        open_ = left
    wide = max(map(len, more.values()), default=0)
    extra = np.full((n, wide), -1, np.int32)
    for node, to in more.items():
        extra[node, : len(to)] = to
    return np.concatenate([edges, extra], 1)


def _joined(points: np.ndarray, at: np.ndarray, old: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Old and further edges; pruned where they are too many."""
    both = -np.sort(-np.concatenate([old, more], 1), 1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    out = -np.sort(-both, 1)[:, :DEGREE]
    many = (both >= 0).sum(1) > DEGREE
    if many.any():
        out[many] = pruned(points, at[many], both[many])
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.asarray(c.flatten(), np.float64) for c in chunks]).reshape(-1, dim)


def build_index(vectors: DataFrame, k: int = 5, shard: int = SHARD) -> DataFrame:
    """One row a shard and length of vectors(vec_id, embedding): dim, n, mat, edges, entries, ids (of each node up to k + 1)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x")).filter(valid(F.col("x")))
    rows = rows.withColumn("h", F.xxhash64("x"))
    nth = F.row_number().over(W.partitionBy("h", "x").orderBy(F.asc_nulls_last("id")))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    nodes = written(few.groupBy("h", "x").agg(F.array_sort(F.collect_list(F.struct("nth", "id"))).alias("ids")).select("h", "x", F.size("x").alias("dim"), F.transform("ids", lambda i: i["id"]).alias("ids")), "nodes")
    shards = -(-nodes.count() // shard) or 1
    dealt = nodes.withColumn("shard", F.pmod("h", F.lit(shards))).drop("h")

    def make(key: tuple, group: pa.Table) -> pa.Table:
        dim = key[1].as_py()
        mat = _matrix(group["x"], dim)
        x, size = unit(mat)
        edges, entries = graph((x / size[:, None]).astype(np.float32))
        ids = pa.array([group["ids"].combine_chunks().to_pylist()], pa.list_(pa.list_(pa.int64())))
        return pa.table({"dim": pa.array([dim], pa.int32()), "n": pa.array([len(mat)], pa.int32()), "mat": [mat.tobytes()], "edges": [edges.tobytes()], "entries": [entries.tobytes()], "ids": ids})

    return written(dealt.groupBy("shard", "dim").applyInArrow(make, "dim int, n int, mat binary, edges binary, entries binary, ids array<array<bigint>>"), "graphs")


def _packed(queries: DataFrame) -> DataFrame:
    """Rows (q_dim, q_n, q_ids, q_keys, q_copies, q_mat) of at most QUERY_BLOCK queries of one length, within each task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list] = {}

        def row(dim: int) -> pa.RecordBatch:
            ids, keys, copies, mats = zip(*open_.pop(dim), strict=True)
            cells = [np.array(c, np.int64).tobytes() for c in (ids, keys, copies)]
            return pa.RecordBatch.from_pydict({"q_dim": pa.array([dim], pa.int32()), "q_n": pa.array([len(ids)], pa.int32()), "q_ids": [cells[0]], "q_keys": [cells[1]], "q_copies": [cells[2]], "q_mat": [np.array(mats, np.float64).tobytes()]})

        for batch in batches:
            for cell in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                x = np.asarray(cell[3].values, np.float64)
                part = open_.setdefault(len(x), [])
                part.append((*cell[:3], x))
                if len(part) == QUERY_BLOCK:
                    yield row(len(x))
        for dim in list(open_):
            yield row(dim)

    return queries.select("id", "key", "copies", "x").mapInArrow(pack, "q_dim int, q_n int, q_ids binary, q_keys binary, q_copies binary, q_mat binary")


def search(index: DataFrame, queries: DataFrame, k: int = 5, width: int = WIDE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found in the index for each row of queries(vec_id, embedding), itself not among them."""
    rows = queries.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x")).filter(F.col("id").isNotNull() & valid(F.col("x")))
    one = rows.groupBy("id", "x").agg(F.count(F.lit(1)).alias("copies")).withColumn("key", F.xxhash64("x"))
    asked = kept(_packed(one))
    size = asked.agg(F.sum(F.length("q_mat") + 24 * F.col("q_n"))).first()[0] or 0
    if size <= SEND_BYTES:
        pairs = index.join(F.broadcast(asked), F.col("dim") == F.col("q_dim"))
    else:  # blocks of queries are dealt to every group of shards
        groups = max(1, index.count() // 16)
        pairs = index.withColumn("g", F.pmod(F.xxhash64("entries", "n", "mat"), F.lit(groups))).join(asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))), "g").filter("dim = q_dim").drop("g")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}
                dim = cell["dim"].as_py()
                mat = np.frombuffer(cell["mat"].as_py(), np.float64).reshape(-1, dim)
                edges = np.frombuffer(cell["edges"].as_py(), np.int32).reshape(len(mat), -1)
                ids = cell["ids"].as_py()
                q = np.frombuffer(cell["q_mat"].as_py(), np.float64).reshape(-1, dim)
                q_ids, q_keys, q_copies = (np.frombuffer(cell[c].as_py(), np.int64) for c in ("q_ids", "q_keys", "q_copies"))
                (v, v_size), (w, w_size) = unit(mat), unit(q)
                nodes, _ = beam((v / v_size[:, None]).astype(np.float32), edges, np.frombuffer(cell["entries"].as_py(), np.int32), (w / w_size[:, None]).astype(np.float32), width)
                row, col = np.nonzero(nodes >= 0)
                node = nodes[row, col]
                score = np.full(nodes.shape, -np.inf)
                score[row, col] = np.einsum("ij,ij->i", w[row], v[node]) / (w_size[row] * v_size[node])
                order = np.argsort(-score, 1, kind="stable")
                out: list[tuple] = []
                for a in range(len(q)):
                    found, own = [], True
                    for b in order[a].tolist():
                        s = score[a, b]
                        if not np.isfinite(s) or len(found) >= k and s < found[k - 1][0]:
                            break
                        for x in ids[nodes[a, b]]:
                            if own and x == q_ids[a] and (mat[nodes[a, b]] == q[a]).all():
                                own = False  # the query's own row
                            else:
                                found.append((float(s), x))
                        found.sort(key=lambda f: (-f[0], f[1] is None, f[1] or 0))
                    out += [(q_ids[a], q_keys[a], q_copies[a], x, s) for s, x in found[:k]]
                cells = zip(*out, strict=True) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["q", "key", "copies", "v", "s"])

    found = pairs.mapInArrow(compare, "q long, key long, copies long, v long, s double")
    rank = F.row_number().over(W.partitionBy("q", "key").orderBy(F.desc("s"), F.asc_nulls_last("v")))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select(F.col("q").alias("query_id"), "rank", F.col("v").alias("vec_id"), F.col("s").alias("score"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def nearest(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5) -> DataFrame:
    """search() of the rows for which is_query(vec_id) holds in an index of all rows."""
    return search(build_index(vectors, k), vectors.filter(is_query(F.col("vec_id").cast("long"))), k)
