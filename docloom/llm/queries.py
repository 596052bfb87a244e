"""The operators' queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, mixing, neighbours, passages, periodic, quality, repair, secrets, sharding, simhash, tokencount, tokenfile, topk
from docloom.llm.common import scratch, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.with_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.documents_of(tokenfile.read_tokens(spark, path))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, 5)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = quality.train(docs, table(spark, sf_dir, "labels"), keep=fold != 0)
    scored = quality.with_score(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, width=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), 8)


def _damaged_words(doc_id: F.Column, text: F.Column) -> F.Column:
    """Of every tenth document or so, by the checksum of its id, the words from one on repeat with a period; others stay."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(w: F.Column) -> F.Column:
        n, g = F.size(w), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.when(n > 0, F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p)))).otherwise(w), " ")

    return F.when(h % 10 == 0, F.element_at(F.transform(F.array(words), repeated), 1)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _damaged_words(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.with_runs(docs, ["doc_id"])
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return (
        found.withColumn("best", best)
        .select(
            "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.length")).alias("length"), F.col("best.period").alias("period"),
            F.floor(-1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
            F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
            F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        )
    )


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, 5)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return repair.repairs(repair.damaged(talks), talks)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_mix_sources, op3_token_counts, op4_token_file, op5_top_k, op6_secrets, op7_quality, op8_simhash, op9_passages, op10_shards, op11_periodic_runs, op12_neighbours, op13_conversation_repair)}

def _repair_sql() -> str:
    """Damage, faults and the cheapest edits as a recursion over rows. Inserting is left out: deleting the row that it would pair with costs less."""
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"
    white = r"\x20\x09-\x0D"
    state = lambda s, cost, letter, line: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {s}.t{line}}}"
    never = "{'c': 1000000, 'a': '', 't': ''}"
    stay = "CASE WHEN fault IN ('b', 'd') THEN 1000000 WHEN fault = 't' THEN 5 ELSE 0 END"
    keep = lambda s, i: state(s, f"{stay} + CASE WHEN i = '{i}' THEN 0 ELSE 1000000 END", "K", " || chr(10) || role || ':' || text")
    turned = lambda s, role: state(s, f"{stay} + 1", "R", f" || chr(10) || '{role}:' || text")
    best = lambda *x: f"list_sort([{', '.join(x)}])[1]"
    gone = lambda s: state(s, 2, "D", "")
    return f"""
WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
     h AS (SELECT *, {crc} % 20 AS d FROM base),
     damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, range(2) c(i) WHERE d <> 0 AND (c.i = 0 OR d = 3)),
     laid AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
     rows_ AS (SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before,
         CASE WHEN NOT regexp_matches(text, '[^{white}]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][{white}]*\\z') THEN 't' ELSE '' END AS fault FROM laid),
     counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS last FROM rows_ GROUP BY 1),
     dp AS (SELECT conv_id, 0::BIGINT AS n, {{'c': 0, 'a': '', 't': ''}} AS s0, {never} AS s1, {never} AS s2, {never} AS s3 FROM counts
         UNION ALL SELECT dp.conv_id, rows_.n, {gone('s0')}, {best(gone('s1'), keep('s0', 's'))}, {best(gone('s2'), *(x for s in ('s0', 's1', 's3') for x in (keep(s, 'u'), turned(s, 'user'))))}, {best(gone('s3'), keep('s2', 'a'), turned('s2', 'assistant'))}
         FROM dp JOIN rows_ ON rows_.conv_id IS NOT DISTINCT FROM dp.conv_id AND rows_.n = dp.n + 1),
     ends AS (SELECT counts.*, {best('s0', 's3')} AS x FROM counts JOIN dp ON counts.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.n = counts.last),
     ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(x.c, 0)::BIGINT AS cost, coalesce(x.a, '') AS audit, sha256(substr(coalesce(x.t, ''), 2)) AS repaired_sha256
FROM ids LEFT JOIN ends ON ids.conv_id IS NOT DISTINCT FROM ends.conv_id"""


ORACLE_SQL = {
    "op13_conversation_repair": _repair_sql(),
    "op5_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
