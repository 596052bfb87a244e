"""The given tables as the operators' inputs, in Spark and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.sources.scratch import table


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents: the source is the document, doc_id the page."""
    return table(spark, d, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))


BLOCKS = "blocks AS (SELECT source AS document_id, doc_id AS page, unnest(range(0, len(l))) AS ordinal, unnest(l) AS text FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents))"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").cast("int").alias("page"), "text", F.when(F.col("n_chars") < 20, "unreadable").alias("error"), "lang")


PAGES = "pages_ AS (SELECT source AS document_id, CAST(doc_id AS INTEGER) AS page, text, CASE WHEN n_chars < 20 THEN 'unreadable' END AS error, lang FROM documents)"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    c = F.concat_ws("-", "source", "doc_id")
    return table(spark, d, "documents").select(c.alias("id"), c.alias("chunk_id"), F.lit("p").alias("project_id"), F.col("lang").alias("section_id"), F.upper("lang").alias("section_name"), F.concat_ws(" > ", "source", "lang").alias("section_path"), F.col("source").alias("document_id"), F.col("doc_id").cast("int").alias("page"), F.lit("b01").alias("block_id"), F.col("text").alias("text"), F.when(F.col("doc_id") % 7 == 0, 0).otherwise(1).alias("sectioning_version"), F.lit(None).cast("string").alias("_corrupt_record"))


CHUNKS = "chunks AS (SELECT source || '-' || doc_id AS chunk_id, lang AS section_id, upper(lang) AS section_name, source || ' > ' || lang AS section_path, source AS document_id, CAST(doc_id AS INTEGER) AS page, 'b01' AS block_id, text, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 END AS sectioning_version FROM documents)"


def qa(spark: SparkSession, d: str) -> DataFrame:
    """A user's turn, the answer after it, and the user's next turn as the truth."""
    c = table(spark, d, "conversations")
    pick = lambda role, shift, name: c.filter(F.col("role") == role).select("conv_id", (F.col("turn") - shift).alias("turn"), F.col("text").alias(name))
    key = ["conv_id", "turn"]
    rows = pick("user", 0, "question").join(pick("assistant", 1, "answer"), key).join(pick("user", 2, "truth"), key)
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), "conv_id", "turn", "question", "answer", "truth")


QA = "qa AS (SELECT u.conv_id || '-' || u.turn AS question_id, u.conv_id, u.turn, u.text AS question, a.text AS answer, t.text AS truth FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' JOIN conversations t ON t.conv_id = u.conv_id AND t.turn = u.turn + 2 AND t.role = 'user' WHERE u.role = 'user')"


def log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a query log: each has props.k attempts' worth of tokens."""
    k = F.get_json_object("props", "$.k").cast("int")
    method = F.element_at(F.array(*map(F.lit, ("basic", "local", "global", "drift"))), (F.col("user_id") % 4 + 1).cast("int"))
    attempts = F.transform(F.sequence(F.lit(0), k % 3), lambda i: F.struct(F.element_at(F.array(*map(F.lit, ("basic", "local", "global", "drift"))), ((F.col("user_id") + i) % 4 + 1).cast("int")).alias("method"), F.when((i == k % 3) & (F.col("event_type") != "error"), "found").otherwise("not_found").alias("status")))
    return table(spark, d, "events").select(
        F.col("event_id").alias("query_id"), F.col("event_id").alias("ordinal"), F.col("ts").alias("started_at"), F.col("ts").alias("completed_at"), F.concat(F.lit("p"), F.col("user_id") % 5).alias("project_id"), F.concat_ws(" ", "event_type", "user_id").alias("question"),
        F.col("event_type").alias("method"), F.when(F.col("event_type") == "purchase", method).otherwise(F.lit("auto")).alias("requested_method"), F.when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETED").alias("status"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("answer "), "event_id")).alias("answer"), F.col("value").alias("duration_seconds"), F.when(F.col("event_type") == "view", F.lit(None)).when(F.col("event_type") == "click", "manual").otherwise("batch").alias("source"),
        F.when(F.col("event_type").isin("click", "view", "error"), attempts).alias("attempts"), F.when(F.col("event_type") == "signup", k % 4).alias("search_step_count"),
        F.when(k >= 10, F.array(F.lit("call"))).alias("llm_calls"), (k % 5).alias("model_call_count"), F.when(k % 6 != 0, k * 10).alias("prompt_tokens"), F.when(k % 4 != 0, k).alias("completion_tokens"),
    )


LOG = """log AS (SELECT event_id AS query_id, ts AS started_at, 'p' || (user_id % 5) AS project_id, event_type || ' ' || user_id AS question, event_type AS method,
  CASE WHEN event_type = 'purchase' THEN ['basic','local','global','drift'][user_id % 4 + 1] ELSE 'auto' END AS requested_method,
  CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN event_type <> 'error' THEN 'answer ' || event_id END AS answer, value AS duration_seconds,
  CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN 'manual' ELSE 'batch' END AS source,
  CASE WHEN event_type IN ('click','view','error') THEN k % 3 + 1 ELSE 0 END AS n_attempts, ['basic','local','global','drift'][user_id % 4 + 1] AS m0,
  CASE WHEN k % 3 = 0 AND event_type <> 'error' THEN true ELSE false END AS found0,
  CASE WHEN event_type = 'signup' THEN k % 4 END AS steps, k >= 10 AS has_calls, k % 5 AS calls, CASE WHEN k % 6 <> 0 THEN k * 10 END AS p, CASE WHEN k % 4 <> 0 THEN k END AS c
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)),
costs AS (SELECT *, CASE WHEN n_attempts > 0 THEN n_attempts WHEN steps IS NOT NULL THEN steps WHEN requested_method IN ('local','global','drift','basic') THEN 1 END AS search_count,
  CASE WHEN has_calls THEN calls END AS llm_call_count, CASE WHEN has_calls THEN p END AS prompt_tokens, CASE WHEN has_calls THEN c END AS completion_tokens,
  CASE WHEN has_calls THEN p + coalesce(c, 0) END AS total_tokens, CASE WHEN n_attempts > 0 THEN m0 END AS first_method, CASE WHEN n_attempts > 0 THEN found0 END AS first_choice_found FROM log)"""


def results(spark: SparkSession, d: str) -> DataFrame:
    """Orders as experiment results: priority is the group, status the question set."""
    grade = F.round(F.col("o_totalprice") % 200000 / 100000, 1)
    k = F.col("o_orderkey")
    raw = F.when(k % 11 == 0, "正確").when(k % 11 == 1, "50%").when(k % 11 == 2, "2 ok").when(k % 11 == 3, F.lit(None)).when(k % 11 == 4, "9").when(k % 11 == 5, "nonsense").otherwise(grade.cast("string"))
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("group_id"), F.col("o_orderstatus").alias("dataset_id"), k.alias("question_id"), raw.alias("evaluation_result"), F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("a"), k)).alias("actual_answer"),
        F.when(k % 3 != 0, k % 7 / 7).alias("source_score"), F.when(k % 5 != 0, k % 2 * 1.0).alias("answer_em"), F.when(k % 5 != 0, k % 9 / 9).alias("answer_f1"), (k % 2 * 1.0).alias("answer_term_hit"), (k % 4 / 4).alias("answer_term_coverage"),
        F.when(k % 17 != 0, F.col("o_totalprice") / 1000).alias("duration_seconds"), (k % 19 == 0).alias("manual_override"), (k % 3 / 2).alias("extra_share"), F.when(k % 23 == 0, "failed").otherwise("completed").alias("status"),
        F.when(k % 4 == 0, "m1").otherwise("m2").alias("answer_model"), F.concat(F.lit("q"), F.col("o_custkey")).alias("question"), F.concat(F.lit("t"), k % 10).alias("correct_answer"),
    )


RESULTS = """results AS (SELECT *, CASE WHEN k % 11 = 0 THEN 2.0 WHEN k % 11 = 1 THEN 1.0 WHEN k % 11 = 2 THEN 2.0 WHEN k % 11 IN (3, 4, 5) THEN NULL ELSE round(fmod(o_totalprice, 200000) / 100000, 1) END AS grade FROM (
  SELECT o_orderpriority AS group_id, o_orderstatus AS dataset_id, o_orderkey AS question_id, o_orderkey AS k, o_totalprice, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'a' || o_orderkey END AS actual_answer,
  CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 7) / 7 END AS source_score, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 2) * 1.0::DOUBLE END AS answer_em, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 9) / 9 END AS answer_f1,
  (o_orderkey % 2) * 1.0::DOUBLE AS answer_term_hit, (o_orderkey % 4) / 4 AS answer_term_coverage, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice / 1000 END AS duration_seconds, o_orderkey % 19 = 0 AS manual_override, (o_orderkey % 3) / 2 AS extra_share FROM orders)),
combined AS (SELECT *, CASE WHEN grade IS NULL THEN 0 ELSE round(least(1.0, grade / 2 + (CASE WHEN manual_override THEN 0 ELSE extra_share END) * 0.1 * coalesce(source_score, 0)), 4) END AS comb FROM results)"""


def judges(spark: SparkSession, d: str) -> DataFrame:
    """Labels as two judges' scores of each document."""
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("question_id"), F.expr("stack(2, 'quality', cast(quality as double), 'toxic', cast(1 - toxic as double)) AS (model, score)"))
    bad = F.col("question_id") % 17 == 0
    return rows.select("question_id", "model", F.when(~bad, F.col("score")).alias("score"), F.concat("model", F.lit(" says "), F.col("score").cast("int")).alias("reason"), F.when(bad, "no reply").alias("error"), ((F.col("question_id") % 2 == 0) & (F.col("score") < 1)).alias("extra_content_error"))


JUDGES = "judges AS (SELECT question_id, model, CASE WHEN question_id % 17 <> 0 THEN s END AS score, model || ' says ' || CAST(s AS INTEGER) AS reason, CASE WHEN question_id % 17 = 0 THEN 'no reply' END AS error, question_id % 2 = 0 AND s < 1 AS extra FROM (SELECT doc_id AS question_id, 'quality' AS model, CAST(quality AS DOUBLE) AS s FROM labels UNION ALL SELECT doc_id, 'toxic', 1.0 - toxic FROM labels))"


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Part lines as retrieved evidence: the order asks, the supplier is the document, the part's size the page."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    e = table(spark, d, "lineitem").withColumn("rank", F.row_number().over(order)).select(F.col("l_orderkey").alias("question_id"), "rank", F.col("l_suppkey").cast("string").alias("document_id"), (F.col("l_partkey") % 40).cast("int").alias("page"), F.col("l_partkey").cast("string").alias("context_id"), "l_returnflag")
    return e.select("question_id", "rank", F.concat(F.lit("E"), "rank").alias("evidence_id"), "context_id", F.col("context_id").alias("text_unit_id"), "document_id", F.when(F.col("page") > 0, F.col("page")).alias("page"), F.when(F.col("page") % 3 == 1, F.array("page", F.col("page") + 1)).alias("pages"), F.when(F.col("l_returnflag") == "R", "community_report").otherwise("text_unit").alias("source_type"), F.lit("").alias("added_by"))


EVIDENCE = """evidence AS (SELECT question_id, rank, 'E' || rank AS evidence_id, context_id, document_id, CASE WHEN page > 0 THEN page END AS page,
  CASE WHEN page % 3 = 1 THEN [page, page + 1] WHEN page > 0 THEN [page] ELSE [] END AS pages, CASE WHEN f = 'R' THEN 'community_report' ELSE 'text_unit' END AS source_type
  FROM (SELECT l_orderkey AS question_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INTEGER) AS rank, CAST(l_suppkey AS VARCHAR) AS document_id, CAST(l_partkey % 40 AS INTEGER) AS page, CAST(l_partkey AS VARCHAR) AS context_id, l_returnflag AS f FROM lineitem))"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Orders as answers that cite some of their evidence."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("question_id"), F.concat(F.lit("Turn it. [Data: Sources ("), (F.col("o_custkey") % 40).cast("string"), F.lit(", "), (k * 3 % 200).cast("string"), F.lit(")] And stop. [E"), (k % 3 + 1).cast("string"), F.lit("]")).alias("answer"))


ANSWERS = "answers AS (SELECT o_orderkey AS question_id, CAST(o_custkey % 40 AS VARCHAR) AS c1, CAST(o_orderkey * 3 % 200 AS VARCHAR) AS c2, 'E' || (o_orderkey % 3 + 1) AS ce FROM orders)"


def gold(spark: SparkSession, d: str) -> DataFrame:
    """The first line of an order and the one after it as its gold sources; every fifth has the document only."""
    e = evidence(spark, d).filter("rank <= 2")
    pages_ = F.when((F.col("question_id") % 5 == 0) | F.col("page").isNull(), F.array().cast("array<int>")).otherwise(F.array(F.col("page") + F.col("question_id") % 3))
    return e.filter("question_id % 4 <> 0").select("question_id", "document_id", pages_.cast("array<int>").alias("pages"), F.array("context_id").alias("chunk_ids"))


GOLD = "gold AS (SELECT question_id, document_id, CASE WHEN question_id % 5 = 0 OR page IS NULL THEN [] ELSE [CAST(page + question_id % 3 AS INTEGER)] END AS pages FROM evidence WHERE rank <= 2 AND question_id % 4 <> 0)"


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts, with their lines as degree."""
    li = table(spark, d, "lineitem")
    deg = li.groupBy(F.concat(F.lit("s"), "l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("degree")).unionByName(li.groupBy(F.concat(F.lit("p"), "l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("degree")))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("title"), F.when(F.col("s_suppkey") % 10 != 0, "supplier").alias("type"), F.col("s_name").alias("description"), F.col("s_suppkey").cast("long").alias("position"))
    p = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("type"), F.concat_ws(" ", "p_name", "p_brand").alias("description"), (F.col("p_partkey") + 1_000_000).alias("position"))
    return s.unionByName(p).join(deg, "id", "left").withColumn("frequency", F.col("degree"))


ENTITIES = """deg AS (SELECT 's' || l_suppkey AS id, count(*) AS degree FROM lineitem GROUP BY 1 UNION ALL SELECT 'p' || l_partkey, count(*) FROM lineitem GROUP BY 1),
entities AS (SELECT e.*, degree FROM (SELECT 's' || s_suppkey AS id, s_name AS title, CASE WHEN s_suppkey % 10 <> 0 THEN 'supplier' END AS type, s_name AS description, CAST(s_suppkey AS BIGINT) AS position FROM supplier
  UNION ALL SELECT 'p' || p_partkey, p_name, p_type, p_name || ' ' || p_brand, p_partkey + 1000000 FROM part) e LEFT JOIN deg USING (id))"""


def relationships(spark: SparkSession, d: str) -> DataFrame:
    """Lines between supplier and part, weighted by number."""
    li = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("source"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("target"))
    return li.join(s, "l_suppkey").join(p, "l_partkey").select("source", "target", "weight", F.concat_ws(" to ", "source", "target").alias("description"))


RELATIONSHIPS = "relationships AS (SELECT s_name AS source, p_name AS target, CAST(count(*) AS DOUBLE) AS weight, l_suppkey, l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)"


def communities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Regions are level 0, nations level 1; members are suppliers; regions but one have reports."""
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    sn = s.join(n, s.s_nationkey == n.n_nationkey).select(F.concat(F.lit("s"), "s_suppkey").alias("id"), "n_nationkey", "n_regionkey")
    top = r.join(sn.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("id")).alias("entity_ids")), r.r_regionkey == F.col("n_regionkey"), "left").select(F.col("r_regionkey").cast("int").alias("community"), F.lit(0).alias("level"), F.col("r_name").alias("title"), "entity_ids")
    low = n.join(sn.groupBy(F.col("n_nationkey").alias("_n")).agg(F.array_sort(F.collect_list("id")).alias("entity_ids")), n.n_nationkey == F.col("_n"), "left").select((F.col("n_nationkey") + 100).cast("int").alias("community"), F.lit(1).alias("level"), F.col("n_name").alias("title"), "entity_ids")
    both = top.unionByName(low)
    reports = both.filter("community % 5 <> 3").select("community", "level", F.concat(F.lit("Report "), "title").alias("title"), F.concat(F.lit("About "), "title").alias("summary"), (F.col("community") % 7 + 0.25).cast("double").alias("rank"))
    return both, reports


COMMUNITIES = """sn AS (SELECT 's' || s_suppkey AS id, n_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
communities AS (SELECT CAST(r_regionkey AS INTEGER) AS community, 0 AS level, r_name AS title, (SELECT count(*) FROM sn WHERE sn.n_regionkey = r_regionkey) AS members FROM region
  UNION ALL SELECT CAST(n_nationkey + 100 AS INTEGER), 1, n_name, (SELECT count(*) FROM sn WHERE sn.n_nationkey = nation.n_nationkey) FROM nation),
reports AS (SELECT community, level, 'Report ' || title AS title, 'About ' || title AS summary, CAST(community % 7 + 0.25 AS DOUBLE) AS rank FROM communities WHERE community % 5 <> 3)"""


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Headers of pages: every third document has a tag by its language, the others a chapter."""
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("["), F.upper("lang"), F.lit(" WITH TAG]\n< Chapter "), F.expr("doc_id div 30"), F.lit(" >"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("< Chapter "), F.expr("doc_id div 30"), F.lit(" >"))).otherwise("")
    return table(spark, d, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").cast("int").alias("page"), head.alias("text"))


TAGS = """tags AS (SELECT source AS document_id, CAST(doc_id AS INTEGER) AS page, CASE WHEN doc_id % 3 = 0 THEN upper(lang) || ' WITH TAG' ELSE '' END AS variant, CASE WHEN doc_id % 3 < 2 THEN 'Chapter ' || (doc_id // 30) ELSE '' END AS chapter FROM documents),
islands AS (SELECT *, sum(CASE WHEN variant <> '' OR chapter = '' OR chapter IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY page) AS i FROM (SELECT *, lag(chapter) OVER (PARTITION BY document_id ORDER BY page) AS prev FROM tags)),
catalog AS (SELECT document_id, page, first_value(variant) OVER (PARTITION BY document_id, i ORDER BY page) AS variant, chapter FROM islands)"""


def generated(spark: SparkSession, d: str) -> DataFrame:
    """First words of documents as generated questions, in rounds."""
    words = F.array_join(F.slice(F.split("text", r"\s+"), 1, 2), " ")
    return table(spark, d, "documents").select(F.expr("cast(doc_id % 3 + 1 as int)").alias("round"), F.col("source").alias("document_id"), F.col("doc_id").alias("position"), words.alias("question"))


def manual(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(headers, pages) of manuals with chapters for several variants: four pages in a row have one text, and stand in one document."""
    docs = table(spark, d, "documents")
    first = docs.select(F.col("doc_id").alias("_first"), F.col("source").alias("document_id"), F.col("text").alias("body"))
    rows = docs.join(first, F.col("doc_id") - F.col("doc_id") % 4 == F.col("_first"))
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("["), F.upper("lang"), F.lit(" WITH TAG]\n< Chapter "), F.expr("doc_id div 30"), F.lit(" >"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("< Chapter "), F.expr("doc_id div 30"), F.lit(" >"))).otherwise("")
    page = F.col("doc_id").cast("int").alias("page")
    return rows.select("document_id", page, head.alias("text")), rows.select("document_id", page, F.col("body").alias("text"))


MANUAL = TAGS.replace("FROM documents)", "FROM manual)").replace("source AS document_id", "document_id")
MANUAL = """manual AS (SELECT d.doc_id, d.lang, f.source AS document_id, f.text AS body FROM documents d JOIN documents f ON f.doc_id = d.doc_id - d.doc_id % 4),
""" + MANUAL
