"""Routing and retrieval over tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docloom.sources.scratch import kept

# ---- fixed values ----
METHOD_ORDER = ["basic", "local", "global", "drift"]
LOCAL_MIN_SOURCES = 7
# ---- end of fixed values ----
SEND_BYTES, AUTOMATON_BYTES, SORT_PARTS, HUB_PARTS = 64 << 20, 4 << 20, 256, 8


_automata: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, rows: list[tuple]) -> ahocorasick.Automaton:
    """Of the keys of rows (ordinal, key, position, term), with their terms; made once a worker."""
    if name not in _automata:
        _automata.clear()
        found = ahocorasick.Automaton()
        terms: dict[str, list] = {}
        for ordinal, key, position, term in rows:
            terms.setdefault(key, []).append((ordinal, position, term))
        for key, cells in terms.items():
            if key:
                found.add_word(key, cells)
        found.make_automaton()
        _automata[name] = (found, terms.get("", []))
    return _automata[name]


def _terms_of(question: str, automaton: ahocorasick.Automaton, always: list) -> list[str] | None:
    met: dict[int, list] = {id(always): always} if always else {}
    if len(automaton):
        for _, cells in automaton.iter(question):
            met[id(cells)] = cells
    rows = sorted({r for cells in met.values() for r in cells if r[2] not in question})
    return list(dict.fromkeys(r[2] for r in rows)) or None


def _grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))))


def _terms_by_grams(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(question_id, _terms) by an index of the keys' rarest grams of up to three characters: only equal grams meet."""
    keys = aliases.select("key").distinct()
    cells = keys.select("key", F.explode(F.when(F.length("key") < 3, F.array("key")).otherwise(_grams(F.col("key"), 3))).alias("gram"))
    often = cells.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    index = cells.join(often, "gram").groupBy("key").agg(F.min_by("gram", F.struct("often", "gram")).alias("gram"))
    parts = F.flatten(F.array_compact(F.array(F.array(F.lit("")), *(_grams(F.col("question"), n) for n in (1, 2, 3)))))
    asked = questions.select("question_id", "question").filter("question is not null")
    met = asked.select("question_id", "question", F.explode(parts).alias("gram")).join(index, "gram").filter(F.contains("question", F.col("key"))).join(aliases, "key").filter(~F.contains("question", F.col("term")))
    return met.groupBy("question_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct("ordinal", "position", "term"))), lambda x: x["term"])).alias("_terms"))


def expand_query(questions: DataFrame, aliases: DataFrame, send_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """A question with the alias terms of the keys that it contains, first seen, not already in it.

    aliases(ordinal, key, position, term). A dictionary of up to ``send_bytes`` is sent to the workers as one
    automaton that finds all keys in one pass over a question, without any shuffle; a larger one is an
    index by the keys' rarest grams, joined with the questions' grams. A null question stays null.
    """
    rows = aliases.select("ordinal", "key", "position", "term").filter("key is not null and term is not null")
    size = rows.agg(F.sum(F.octet_length("key") + F.octet_length("term") + 16)).first()[0] or 0
    if size <= send_bytes:
        name, sent = uuid.uuid4().hex, questions.sparkSession.sparkContext.broadcast([tuple(r) for r in rows.collect()])

        @F.pandas_udf("array<string>")
        def terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            found = _automaton(name, sent.value)
            for part in batches:
                yield pd.Series([None if q is None else _terms_of(q, *found) for q in part], dtype=object)

        met = questions.withColumn("_terms", terms("question"))
    else:
        met = questions.join(_terms_by_grams(questions, rows), "question_id", "left")
    return met.withColumn("expanded", F.when(F.col("_terms").isNotNull(), F.concat("question", F.lit("\nRelated manual terms: "), F.array_join("_terms", "; "))).otherwise(F.col("question"))).drop("_terms")


def attempt_order(chosen: Column, ranking: Column) -> Column:
    """Chosen method, ranking, then the default order; a ranking with an unknown method is not used at all."""
    r = F.coalesce(ranking, F.array().cast("array<string>"))
    bad = F.exists(r, lambda m: F.coalesce(~m.isin(METHOD_ORDER), F.lit(True))) | ~F.coalesce(chosen.isin(METHOD_ORDER), F.lit(False))
    return F.when(bad, F.lit(METHOD_ORDER)).otherwise(F.array_distinct(F.concat(F.array(chosen), r, F.lit(METHOD_ORDER))))


def attempt_status(attempts: DataFrame) -> DataFrame:
    """attempts(query_id, attempt, method, answer, error, source_count, found) with status."""
    failed = (F.trim(F.coalesce("answer", F.lit(""))) == "") | (F.coalesce("error", F.lit("")) != "")
    thin = (F.col("method") == "local") & (F.col("source_count") < LOCAL_MIN_SOURCES)
    return attempts.withColumn("status", F.when(failed, "failed").when(F.coalesce(thin, F.lit(False)) | ~F.coalesce("found", F.lit(False)), "not_found").otherwise("found"))


def choose_answer(attempts: DataFrame) -> DataFrame:
    """The first found attempt of each query; if none, the first answered method without an answer; else failed."""
    rows = attempt_status(attempts)
    first = lambda s: F.min_by(F.struct("method", "answer", "attempt"), F.when(F.col("status") == s, F.col("attempt")))
    out = rows.groupBy("query_id").agg(first("found").alias("f"), first("not_found").alias("n"), F.min_by("method", "attempt").alias("m"))
    return out.select("query_id", F.coalesce("f.method", "n.method", "m").alias("method"), F.col("f.answer").alias("answer"), F.when(F.col("f").isNotNull(), "found").when(F.col("n").isNotNull(), "not_found").otherwise("failed").alias("status"), F.col("f.attempt").alias("attempts"))


def duplicate_step(steps: DataFrame) -> DataFrame:
    """Steps with ``duplicate``: the same method and query (case and white space apart) as an earlier step."""
    norm = F.trim(F.regexp_replace(F.lower("query"), r"(?U)\s+", " "))
    w = W.partitionBy("question_id", "method", "_norm").orderBy("step")
    return steps.withColumn("_norm", norm).withColumn("duplicate", F.row_number().over(w) > 1).drop("_norm")


def _blocks(vectors: DataFrame, key: str, size: int) -> DataFrame:
    """(dim, ids, mat): vectors of one length, scaled to length 1, up to ``size`` a row; empty, zero and infinite ones stay out."""
    kind = T._parse_datatype_string(dict(vectors.dtypes)[key])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def row(dim: int) -> pa.RecordBatch:
            ids, mats = zip(*held.pop(dim), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([list(ids)], pa.list_(to_arrow_type(kind))), pa.array([np.array(mats).tobytes()], pa.binary())], ["dim", "ids", "mat"])

        for batch in batches:
            for own, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.asarray(cell.values, np.float64) if cell.is_valid and len(cell.values) and not cell.values.null_count else np.zeros(1)
                norm = np.sqrt(x @ x)
                if norm > 0 and np.isfinite(norm):
                    part = held.setdefault(len(x), [])
                    part.append((own, x / norm))
                    if len(part) == size:
                        yield row(len(x))
        for dim in list(held):
            yield row(dim)

    return vectors.select(key, F.col("x").cast("array<double>").alias("x")).mapInArrow(pack, T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("mat", T.BinaryType())]))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, block: tuple[int, int] = (512, 4096)) -> DataFrame:
    """Exact cosine top-k: (query_id, rank, id, score); ties to the smaller id.

    queries(query_id, x), vectors(id, x). Both come in blocks; one matrix product compares a pair of
    blocks, of which each query's k best go on, so the rows that are shuffled grow with queries times blocks. Blocks of queries are sent to the executors if they fit
    SEND_BYTES, else dealt to groups of vector blocks.
    """
    if not 1 <= k <= 100:
        raise ValueError("k must be between 1 and 100")
    q = kept(_blocks(queries, "query_id", block[0]).toDF("q_dim", "q_ids", "q_mat"))
    v = _blocks(vectors, "id", block[1])
    kinds = [T._parse_datatype_string(dict(t.dtypes)[c]) for t, c in ((queries, "query_id"), (vectors, "id"))]
    if (q.agg(F.sum(F.length("q_mat"))).first()[0] or 0) <= SEND_BYTES:
        pairs = v.join(F.broadcast(q), F.col("dim") == F.col("q_dim"))
    else:
        v = kept(v)
        groups = 1 + v.count() // 64
        dealt = q.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        pairs = v.withColumn("g", F.pmod(F.xxhash64("mat"), F.lit(groups))).join(dealt, "g").filter("dim = q_dim")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}
                dim = r["dim"].as_py()
                a, b = (np.frombuffer(r[c].as_py(), np.float64).reshape(-1, dim) for c in ("q_mat", "mat"))
                score = a @ b.T
                if k < len(b):
                    least = np.partition(score, len(b) - k, 1)[:, len(b) - k]
                    row, col = np.nonzero(score >= least[:, None] - 1e-12)
                else:
                    row, col = np.nonzero(np.ones(score.shape, bool))
                # the score itself is summed in one order, whatever the blocks are
                exact = np.einsum("ij,ij->i", a[row], b[col])
                by_id = np.empty(len(b), np.int64)
                by_id[np.asarray(pc.sort_indices(r["ids"].values))] = np.arange(len(b))
                order = np.lexsort((by_id[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                good = np.arange(len(row)) - np.searchsorted(row, row) < k
                yield pa.RecordBatch.from_arrays([r["q_ids"].values.take(pa.array(row[good])), r["ids"].values.take(pa.array(col[good])), pa.array(exact[good])], ["query_id", "id", "score"])

    schema = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("id", kinds[1]), T.StructField("score", T.DoubleType())])
    scored = pairs.select("dim", "ids", "mat", "q_ids", "q_mat").mapInArrow(compare, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def local_expand(top: DataFrame, relationships: DataFrame, entity_units: DataFrame, k: int = 10, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(each query's k heaviest relationships of its top entities, the units linked to these in entity order).

    top(query_id, rank, entity_id), relationships(source, target, weight), entity_units(entity_id, unit_id).
    A hub's relationships lie in several parts, of which each keeps the k heaviest before they meet, as no query can need more.
    Units come with the rank of their first entity and the number of entities that have them; ``most``:
    so many units of each query, by these.
    """
    both = relationships.select(F.col("source").alias("entity_id"), "source", "target", "weight").unionByName(relationships.filter("source <> target").select(F.col("target").alias("entity_id"), "source", "target", "weight"))
    own = F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc("weight"), "source", "target"))
    # an own number of parts, as the sort of a task takes many times the bytes that its rows have in a shuffle; a hub has several
    part = F.pmod(F.xxhash64("source", "target"), F.lit(HUB_PARTS))
    near = both.join(top.select("entity_id").distinct(), "entity_id", "left_semi").withColumn("_part", part).repartition(SORT_PARTS, "entity_id", "_part")
    asked = near.groupBy("entity_id", "_part", "source", "target").agg(F.max("weight").alias("weight"))
    best = F.row_number().over(W.partitionBy("entity_id", "_part").orderBy(F.desc("weight"), "source", "target"))
    asked = asked.withColumn("_n", best).filter(F.col("_n") <= k).drop("_n", "_part")
    few = asked.withColumn("_n", own).filter(F.col("_n") <= k).drop("_n")
    edges = top.select("query_id", "entity_id").join(few, "entity_id").groupBy("query_id", "source", "target").agg(F.max("weight").alias("weight"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("weight"), "source", "target"))
    units = top.join(entity_units.distinct(), "entity_id").groupBy("query_id", "unit_id").agg(F.min("rank").alias("entity_rank"), F.count(F.lit(1)).alias("entities"))
    if most is not None:
        nth = F.row_number().over(W.partitionBy("query_id").orderBy("entity_rank", F.desc("entities"), "unit_id"))
        units = units.withColumn("position", nth).filter(F.col("position") <= most)
    return edges.withColumn("rank", rank).filter(F.col("rank") <= k), units


def reports_at_level(communities: DataFrame, reports: DataFrame, level: int = 2) -> DataFrame:
    """Reports of communities up to a level, by rank."""
    ids = communities.filter(F.col("level") <= level).select("community").distinct()
    return reports.join(ids, "community", "left_semi").orderBy(F.desc_nulls_last("rank"), "community")


def map_model(df: DataFrame, fn: Callable[[dict], str], key: str, out: str = "result", parallel: int | None = None, fatal: type[Exception] | tuple = ()) -> DataFrame:
    """fn(row) for every row, with (key, out, error); a failed row has an error, a fatal one ends its task's calls.

    ``parallel`` tasks call at once. The caller writes the result before aggregating it.
    """
    rows = df.repartition(parallel) if parallel else df
    kind = dict(df.dtypes)[key]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = None
        for part in batches:
            done = []
            for row in part.to_dict("records"):
                if stopped:
                    done.append((row[key], None, f"not called: {stopped}"))
                    continue
                try:
                    done.append((row[key], fn(row), None))
                except Exception as error:  # noqa: BLE001
                    done.append((row[key], None, str(error)))
                    if fatal and isinstance(error, fatal):
                        stopped = str(error)
            yield pd.DataFrame(done, columns=[key, out, "error"])

    return rows.mapInPandas(call, f"{key} {kind}, {out} string, error string")
