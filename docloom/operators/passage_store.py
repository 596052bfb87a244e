"""D3: groups of repeated passages that follow their documents, without comparing all of them again.

Stored are the passages of each document with the id of their set of word triples, the pairs of
similar sets, and the groups that they form with their pages; sets are cut from the stored texts again. A refresh takes
documents whose stamp changed: sets that no passage has any more go with their pairs, new sets meet each other and those of
the stored sets that share enough triples with new ones, and only
groups that lost, gained or moved a passage, or whose sets new pairs reach, are put together again (so a
group whose link went falls apart). All other rows stay as they are.

The five tables are versioned stores of their own; one manifest names the versions that belong together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.components import components
from docloom.operators.passages import CONTAINMENT, SIZE_RATIO, groups_of, pages_of, passages
from docloom.operators.similarity import among, links_of, set_id
from docloom.sources.scratch import packed, tidy, workspace
from docloom.sources.store import DocumentStore, Manifests, few

TABLES = {
    "items": ("document_id", "document_id string, page {page}, ordinal {ordinal}, text string, set bigint, n int"),
    "links": ("a", "a bigint, b bigint"),
    "members": ("set", "set bigint, group bigint"),
    "places": ("group", "group bigint, document_id string, page {page}, text string"),
    "groups": ("group", "group bigint, n_pages bigint, first struct<document_id:string,page:{page}>, text string"),
}
PLACE = ["document_id", "page"]


def _items(blocks: DataFrame) -> DataFrame:
    """Passages with the id and the size of their set of triples."""
    found = passages(blocks.select(*PLACE, "ordinal", "text")).filter(F.size("grams") > 0)
    return found.select(*PLACE, "ordinal", "text", set_id("grams").alias("set"), F.size("grams").alias("n"))


def _cut(items: DataFrame) -> DataFrame:
    return passages(items).withColumnRenamed("set", "id")


class PassageGroups:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Manifests(spark, root)

    def _store(self, name: str) -> DocumentStore:
        return DocumentStore(self.spark, f"{self.root}/{name}")

    def _table(self, name: str) -> DataFrame:
        return self._store(name).read(self.files.read()["versions"][name])

    def stamps(self) -> DataFrame:
        return self.spark.read.schema("document_id string, stamp string").parquet(self.files.read()["stamps"])

    def groups(self) -> DataFrame:
        """(group, n_pages, first, text) of the passages on two pages or more."""
        return self._table("groups")

    def places(self) -> DataFrame:
        """(group, document_id, page, text): the pages of these groups."""
        return self._table("places")

    @classmethod
    def build(cls, blocks: DataFrame, stamps: DataFrame, root: str, buckets: int = 64) -> PassageGroups:
        """Groups of all blocks(document_id, page, ordinal, text); stamps(document_id, stamp) as they are now."""
        self = cls(blocks.sparkSession, root)
        kinds = {k: v for k, v in blocks.dtypes if k in ("page", "ordinal")}
        versions = {}
        for name, (key, schema) in TABLES.items():
            none = self.spark.createDataFrame([], schema.format(**kinds))
            DocumentStore.create(none, f"{self.root}/{name}", key=key, buckets=buckets)
            versions[name] = 0
        none = self.spark.createDataFrame([], "document_id string, stamp string")
        none.write.parquet(f"{self.root}/stamps/none")
        self.files.commit({"versions": versions, "stamps": f"{self.root}/stamps/none"})
        self._change(_items(blocks), stamps, blocks.select("document_id").unionByName(stamps.select("document_id")).distinct())
        return self

    def refresh(self, blocks: DataFrame, stamps: DataFrame) -> PassageGroups:
        """Follow the blocks of documents whose stamps are other ones now, or which are gone; those of others aren't looked at."""
        now, was = stamps.select("document_id", "stamp"), self.stamps()
        changed = packed(now.exceptAll(was).unionAll(was.exceptAll(now)).select("document_id").distinct(), "changed")
        if changed.head(1):
            self._change(_items(blocks.join(few(changed), "document_id", "left_semi")), stamps, changed)
        return self

    def _change(self, found: DataFrame, stamps: DataFrame, changed: DataFrame) -> None:
        with workspace(self.spark, "passages") as keep, tidy(self.spark):
            self._changed(found, stamps, keep(changed, "changed"), keep)

    def _changed(self, found: DataFrame, stamps: DataFrame, changed: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> None:
        state = self.files.read()
        versions = dict(state["versions"])
        was, links, members = (self._table(t) for t in ("items", "links", "members"))

        def replace(name: str, rows: DataFrame, gone: DataFrame, whole: bool = False) -> DataFrame:
            versions[name] = self._store(name).replace(rows, gone=gone, base=versions[name], whole=whole)
            return self._store(name).read(versions[name])

        # passages, read once, and the sets that come and go with them
        items = replace("items", found, changed, whole=True)
        own = F.col("document_id").eqNullSafe(F.col("_changed"))
        keys = few(changed.select(F.col("document_id").alias("_changed")))
        of = lambda rows: rows.join(keys, own, "left_semi").select("set").distinct()
        before, after = keep(of(was), "before"), keep(of(items), "after")
        touched = keep(before.unionByName(after).distinct(), "touched")
        gone = keep(before.join(items.select("set"), "set", "left_anti"), "gone")
        new = keep(after.join(was.select("set"), "set", "left_anti"), "new")
        # pairs: the new sets with each other and with those that stay
        rows = items.withColumn("row", F.xxhash64(*PLACE, "ordinal", "set"))
        kinds = keep(rows.groupBy(F.col("set").alias("id")).agg(F.min("row").alias("row"), F.first("n").alias("n")), "kinds")
        fresh = keep(links_of(rows, _cut, kinds, CONTAINMENT, SIZE_RATIO, keep, new.toDF("id")), "fresh")
        lost = links.join(gone.withColumnRenamed("set", "a"), "a", "left_semi").unionByName(links.join(gone.withColumnRenamed("set", "b"), "b", "left_semi").select("a", "b")).distinct()
        ends = keep(lost.select("a").unionByName(fresh.select("a")).distinct(), "ends")
        kept = links.join(ends, "a", "left_semi").join(lost, ["a", "b"], "left_anti").unionByName(fresh)
        links = replace("links", kept, ends)
        # groups of the touched sets and of all that they are linked with, before or now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.join(touched.withColumnRenamed("set", "a"), "a", "left_semi").select(F.col("b").alias("set"))
        affected = keep(members.join(near.unionByName(touched).distinct(), "set", "left_semi").select("group").distinct(), "affected")
        inside = members.join(affected, "group", "left_semi").select("set")
        vertices = keep(inside.unionByName(new).unionByName(near).distinct().join(gone, "set", "left_anti"), "vertices")
        at = rows.select(*PLACE, "ordinal", "set", "row").join(vertices, "set", "left_semi")
        extent = keep(at.groupBy("set").agg(F.min(F.struct(*PLACE)).alias("first"), F.max(F.struct(*PLACE)).alias("last")), "extents")
        a, b = extent.toDF("a", "a_first", "a_last"), extent.toDF("b", "b_first", "b_last")
        apart = (F.col("a_first") != F.col("a_last")) | (F.col("b_first") != F.col("b_last")) | (F.col("a_first") != F.col("b_first"))
        label = components(vertices.select(F.col("set").alias("fp")), links.join(a, "a").join(b, "b").filter(apart).select("a", "b"))
        label = keep(label.toDF("set", "group"), "labels")
        replace("members", label, vertices.unionByName(gone))
        # texts only of passages in groups on two pages or more
        place = F.struct(*PLACE)
        at = keep(at.join(label, "set").drop("set"), "places")
        wide = at.groupBy("group").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("group")
        at = keep(at.join(wide, "group", "left_semi"), "wide")
        texts = among(rows, "row", at.select("row").distinct()).select("row", "text").dropDuplicates(["row"])
        at = keep(at.join(texts, "row").drop("row"), "members")
        old = affected.unionByName(label.select("group")).distinct()
        replace("places", pages_of(at), old)
        replace("groups", groups_of(at), old)
        path = f"{self.root}/stamps/{uuid.uuid4().hex}"
        stamps.select("document_id", F.col("stamp").cast("string").alias("stamp")).write.parquet(path)
        self.files.commit({"versions": versions, "stamps": path})


def passage_groups_cached(blocks: DataFrame, stamps: DataFrame, root: str) -> DataFrame:
    """D3: the groups of the blocks: as stored where no stamp changed, brought up to date where some did, built if there are none."""
    store = PassageGroups(blocks.sparkSession, root)
    return (store.refresh(blocks, stamps) if store.files.versions() else PassageGroups.build(blocks, stamps, root)).groups()
