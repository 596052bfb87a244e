"""Retrieved records to evidence (M1-M13): nested contexts flattened, resolved to pages, cited."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as t

# ---- fixed values ----
REQUIRED = ["chunk_id", "project_id", "section_id", "section_name", "document_id", "page", "block_id"]
RAW_SCHEMA = "chunk_id string, project_id string, section_id string, section_name string, document_id string, page int, pages array<int>, block_id string, section_path string"
STEP_ROWS, STEP_CHARS = 24, 1200
UNMAPPED = "[來源未映射]"
# ---- end of fixed values ----


def build_source_metadata(documents: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M1: metadata of each text unit from its document's raw data (struct or JSON), and the units without it."""
    raw = F.col("raw_data") if dict(documents.dtypes)["raw_data"].startswith("struct") else F.from_json("raw_data", RAW_SCHEMA)
    docs = documents.select(F.col("id").alias("_doc"), raw.alias("r"))
    full = docs.filter(F.col("_doc").isNotNull())
    for c in REQUIRED:
        full = full.filter(F.col(f"r.{c}").isNotNull())
    u = units.select(F.col("id").alias("text_unit_id"), F.col("document_id").alias("_of"), "text")
    met = u.join(full, u._of == full._doc)
    out = met.select("text_unit_id", *[f"r.{c}" for c in REQUIRED], F.coalesce("r.pages", F.array("r.page")).alias("pages"), F.coalesce("r.section_path", "r.section_name").alias("section_path"), "text")
    missing = u.join(full, u._of == full._doc, "left_anti").select("text_unit_id")
    return out, missing


def metadata_error(missing: DataFrame, shown: int = 3) -> DataFrame:
    """M1: one row with the number of unmatched units and some examples; none if all matched."""
    first = missing.orderBy("text_unit_id").limit(shown).agg(F.array_sort(F.collect_list("text_unit_id")).alias("examples"))
    return missing.agg(F.count(F.lit(1)).alias("n")).crossJoin(first).filter("n > 0")


def _named_items(context: str | None, names: list[str]) -> Iterator[tuple[str, dict]]:
    """(name, item) of the objects in arrays of these names: an object's own arrays, then what its keys of other names hold."""
    try:
        open_ = [json.loads(context)] if context is not None else []
    except ValueError:
        return
    while open_:
        value = open_.pop()
        if isinstance(value, dict):
            own = [n for n in names if isinstance(value.get(n), list)]
            for name in own:
                for item in value[name]:
                    if isinstance(item, dict):
                        yield name, item
            value = [x for k, x in value.items() if k not in names]
        if isinstance(value, list):
            open_ += [x for x in reversed(value) if isinstance(x, dict | list)]


def nested_arrays(contexts: DataFrame, names: list[str]) -> DataFrame:
    """M2: (query_id, ordinal, name, item): the objects of every array of these names, at any depth.

    contexts(query_id, context as JSON). In the order of arrival: keys as the JSON has them, arrays of
    these names before what lies deeper. A null or broken context has none.
    """
    key = contexts.select("query_id").schema.fields
    schema = T.StructType([*key, T.StructField("ordinal", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("item", T.StringType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ordinal, name, item = [], [], [], []
            for i, context in enumerate(batch.column(1).to_pylist()):
                for k, (n, x) in enumerate(_named_items(context, names)):
                    row.append(i)
                    ordinal.append(k + 1)
                    name.append(n)
                    item.append(json.dumps(x, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(ordinal, pa.int32()), pa.array(name, pa.string()), pa.array(item, pa.string())], schema.names)

    return contexts.select("query_id", "context").mapInArrow(walk, schema)


def flatten_context_sources(contexts: DataFrame) -> DataFrame:
    """M2: (query_id, ordinal, id, text, in_context) of every source record."""
    rows = nested_arrays(contexts, ["sources"])
    r = F.from_json("item", "id string, text string, in_context boolean")
    return rows.select("query_id", "ordinal", r.alias("r")).select("query_id", "ordinal", "r.*")


def resolve_evidence(sources: DataFrame, units: DataFrame, metadata: DataFrame, catalog: DataFrame) -> DataFrame:
    """M3: source records to evidence: short id to unit id to metadata; unknown and unused ones are left out.

    units(id, human_readable_id); the first occurrence of a unit counts, rank is the order of arrival.
    """
    used = sources.filter(F.coalesce("in_context", F.lit(True)))
    short = units.select(F.col("human_readable_id").cast("string").alias("_short"), F.col("id").alias("_unit"))
    named = used.join(short, used.id == short._short, "left").select("query_id", "ordinal", F.col("id").alias("context_id"), F.coalesce("_unit", F.col("id")).alias("text_unit_id"))
    nth = F.row_number().over(W.partitionBy("query_id", "text_unit_id").orderBy("ordinal"))
    met = named.withColumn("_n", nth).filter("_n = 1").join(metadata, "text_unit_id").join(catalog, ["document_id", "page"], "left")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("ordinal"))
    variant = F.coalesce("variant", F.lit(""))
    return met.withColumn("rank", rank).select("query_id", F.concat(F.lit("E"), "rank").alias("evidence_id"), "rank", "context_id", "text_unit_id", "chunk_id", "section_id", "section_name", "document_id", "page", "pages", "block_id", "text", F.lit("text_unit").alias("source_type"), t.section_path_with_variant(F.col("section_path"), variant).alias("section_path"), variant.alias("variant"))


def report_evidence(contexts: DataFrame, resolved: DataFrame) -> DataFrame:
    """M4: community reports of queries without resolved sources: first of each id, in order, no page."""
    open_ = contexts.join(resolved.select("query_id").distinct(), "query_id", "left_anti")
    rows = open_.select("query_id", F.posexplode(F.from_json("context", "reports array<struct<id:string,human_readable_id:string,summary:string,content:string,full_content:string,community:string,title:string,in_context:boolean>>")["reports"]).alias("ordinal", "r"))
    full = lambda *c: F.coalesce(*[F.nullif(F.col(f"r.{x}"), F.lit("")) for x in c])
    flat = rows.filter(F.coalesce("r.in_context", F.lit(True))).select("query_id", "ordinal", full("id", "human_readable_id").alias("context_id"), full("summary", "content", "full_content").alias("text"), F.coalesce(full("community"), F.lit("")).alias("section_id"), full("title").alias("title")).filter("context_id is not null and text is not null")
    nth = F.row_number().over(W.partitionBy("query_id", "context_id").orderBy("ordinal"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("ordinal"))
    return flat.withColumn("_n", nth).filter("_n = 1").withColumn("rank", rank).select("query_id", F.concat(F.lit("E"), "rank").alias("evidence_id"), "rank", "context_id", "section_id", F.coalesce("title", F.concat(F.lit("Community Report "), "context_id")).alias("section_name"), "text", F.lit("community_report").alias("source_type"))


def merge_contexts(records: DataFrame) -> DataFrame:
    """M7: records(query_id, ordinal, id, in_context, ..) of several actions: first of each id, used if any copy was."""
    w = W.partitionBy("query_id", "id")
    rows = records.withColumn("_any", F.bool_or(F.coalesce("in_context", F.lit(True))).over(w)).withColumn("_n", F.row_number().over(w.orderBy("ordinal")))
    return rows.filter("_n = 1").withColumn("in_context", F.col("_any")).drop("_any", "_n")


def extract_step_evidence(contexts: DataFrame, rows: int = STEP_ROWS, chars: int = STEP_CHARS) -> DataFrame:
    """M8: sources and reports with text and id of each step: first of each id, so many rows and characters."""
    r = F.from_json("item", "id string, human_readable_id string, text string, content string, summary string, full_content string, in_context boolean")
    flat = nested_arrays(contexts, ["sources", "reports"]).select("query_id", "ordinal", "name", r.alias("r"))
    full = lambda *c: F.coalesce(*[F.nullif(F.col(f"r.{x}"), F.lit("")) for x in c], F.lit(""))
    cells = flat.filter(F.coalesce("r.in_context", F.lit(True))).select("query_id", "ordinal", full("id", "human_readable_id").alias("source_id"), F.when(F.col("name") == "sources", "text_unit").otherwise("community_report").alias("source_type"), t.strip(full("text", "content", "summary", "full_content")).alias("text")).filter("source_id <> '' and text <> ''")
    one = cells.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "source_id").orderBy("ordinal"))).filter("_n = 1")
    return one.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("ordinal"))).filter(F.col("position") <= rows).select("query_id", "position", "source_id", "source_type", F.substring("text", 1, chars).alias("text"))


def assign_citation_ids(evidence: DataFrame) -> DataFrame:
    """M9: evidence(question_id, step, position, source_id, ..) with ids E1.. shared by all steps, in first-seen order."""
    first = evidence.groupBy("question_id", "source_id").agg(F.min(F.struct("step", "position")).alias("_at"))
    ids = first.select("question_id", "source_id", F.concat(F.lit("E"), F.row_number().over(W.partitionBy("question_id").orderBy("_at", "source_id"))).alias("citation_id"))
    return evidence.join(ids, ["question_id", "source_id"])


def align_citations(answers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each [En] of an answer as the id shown to the user, or a marker. mapping(question_id, citation_id, visible_id)."""
    maps = mapping.filter(F.col("visible_id").isNotNull()).groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("citation_id", "visible_id"))).alias("_map"))
    # every citation ends a part, so the parts and citations alternate
    parts = F.split("answer", r"\[E\d+\]")
    cites = F.regexp_extract_all("answer", F.lit(r"\[(E\d+)\]"), F.lit(1))
    shown = lambda c: F.coalesce(F.concat(F.lit("["), F.get(F.map_values(F.map_filter("_map", lambda k, _: k == c)), F.lit(0)), F.lit("]")), F.lit(UNMAPPED))
    rows = answers.join(maps, "question_id", "left").withColumn("_map", F.coalesce("_map", F.create_map().cast("map<string,string>")))
    done = t.let(cites, lambda found: F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(i < F.size(found), shown(F.get(found, i))).otherwise(""))), ""))
    return rows.withColumn("answer", done).drop("_map")


def context_source_count(contexts: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, source_count): distinct used source ids; null only without any context."""
    n = sources.filter(F.coalesce("in_context", F.lit(True))).groupBy("query_id").agg(F.count_distinct(F.coalesce("id", F.col("ordinal").cast("string"))).alias("n"))
    return contexts.join(n, "query_id", "left").select("query_id", F.when(F.col("context").isNotNull(), F.coalesce("n", F.lit(0))).alias("source_count"))


def context_summary(contexts: DataFrame) -> DataFrame:
    """(query_id, key, type, items) of each top-level key of a context."""
    rows = contexts.sparkSession.sql("SELECT s.query_id, e.key, e.value FROM {s} s, LATERAL variant_explode(s.v) e", s=contexts.select("query_id", F.parse_json("context").alias("v")))
    kind = F.regexp_extract(F.schema_of_variant("value"), "^([A-Z]+)", 1)
    n = F.when(kind == "ARRAY", F.size(F.from_json(F.to_json("value"), "array<string>"))).when(kind == "OBJECT", F.size(F.from_json(F.to_json("value"), "map<string,string>")))
    return rows.select("query_id", "key", kind.alias("type"), n.alias("items"))


def unit_locations(units: DataFrame, metadata: DataFrame) -> DataFrame:
    """(context_id, document_id, page): where the unit of a short id stands."""
    return units.join(metadata, units.id == metadata.text_unit_id).select(F.col("human_readable_id").cast("string").alias("context_id"), metadata.document_id, metadata.page)
