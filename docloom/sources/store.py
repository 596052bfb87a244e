"""A table of documents' rows that is replaced document by document, one whole version at a time.

Rows lie in Parquet folders by a hash of the document; a manifest names the folder of each bucket. A
change writes new folders for the buckets that it touches and then one new manifest, so a reader sees all
of it or nothing, a failed job leaves only unused folders, and the cost follows the touched buckets.
A hot document fills one bucket, whose rows still spread over tasks and files.

With a ``stamp`` column (a time or version of the processing) a document's newest stamp wins and rows of
equal stamps add up: it does not matter how many batches a document is spread over, or in what order they
come. Without one, each change replaces the documents that it holds. Each source of batches counts its own
batch numbers; a number that was applied before changes nothing. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.sources.scratch import tidy

BUCKET = "store_bucket"
FEW = 100_000  # keys that go to all tasks


def few(keys: DataFrame) -> DataFrame:
    """Keys that go to all tasks where there are FEW of them, so that the other side of a join is not shuffled."""
    return F.broadcast(keys) if keys.count() <= FEW else keys


class Manifests:
    """Numbered JSON files below a root; the last one is the state. One is there as a whole or not at all."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def names(self, path: str) -> list[str]:
        fs, at = self.fs(f"{self.root}/{path}")
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(x.removesuffix(".json")) for x in self.names("manifests") if x.endswith(".json"))

    def read(self, version: int | None = None) -> dict:
        version = self.versions()[-1] if version is None else version
        text = self.spark.read.text(f"{self.root}/manifests/{version}.json", wholetext=True).head()[0]
        return json.loads(text)

    def commit(self, state: dict) -> int:
        """The state as the next version."""
        version = max(self.versions(), default=-1) + 1
        fs, final = self.fs(f"{self.root}/manifests/{version}.json")
        _, draft = self.fs(f"{self.root}/manifests/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"version {version} was written meanwhile")
        return version

    def delete(self, path: str) -> None:
        fs, at = self.fs(f"{self.root}/{path}")
        fs.delete(at, True)


class DocumentStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Manifests(spark, root)

    def versions(self) -> list[int]:
        return self.files.versions()

    def manifest(self, version: int | None = None) -> dict:
        """What a version (the last one) holds: its settings, the folder of each bucket and the last batch of each source."""
        return self.files.read(version)

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """The rows in new folders: bucket -> folder below the root."""
        place = f"data/{uuid.uuid4().hex}"
        with tidy(self.spark):
            rows.hint("rebalance", F.col(BUCKET)).write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{self.root}/{place}")
        return {x.partition("=")[2]: f"{place}/{x}" for x in self.files.names(place) if x.startswith(f"{BUCKET}=")}

    # ---- tables ----
    @classmethod
    def create(cls, rows: DataFrame, root: str, key: str = "document_id", stamp: str | None = None, gone: str | None = None, buckets: int = 64) -> DocumentStore:
        """A store with these rows as its first version. ``gone``: a column that is true for a row which says that its document has no rows now."""
        store = cls(rows.sparkSession, root)
        if store.versions():
            raise ValueError("there is a store already")
        if BUCKET in rows.columns:
            raise ValueError(f"{BUCKET} is the store's own column")
        settings = {"key": key, "stamp": stamp, "gone": gone, "buckets": buckets, "schema": rows.schema.json(), "folders": {}, "batches": {}}
        settings["folders"] = store._write(store._newest(settings, store._placed(settings, rows)))
        store.files.commit(settings)
        return store

    def _placed(self, settings: dict, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(settings["key"]), F.lit(settings["buckets"])).cast("int"))

    def _newest(self, settings: dict, rows: DataFrame) -> DataFrame:
        if not settings["stamp"]:
            return rows
        key, stamp = settings["key"], settings["stamp"]
        last = rows.groupBy(F.col(key).alias("_key")).agg(F.max(stamp).alias("_last"))
        return rows.join(last, F.col(key).eqNullSafe(F.col("_key")) & F.col(stamp).eqNullSafe(F.col("_last"))).drop("_key", "_last")

    def _stored(self, settings: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(settings["schema"]))
        folders = [f"{self.root}/{f}" for b, f in settings["folders"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        settings = self.manifest(version)
        rows = self._stored(settings)
        return rows.filter(~F.coalesce(settings["gone"], F.lit(False))) if settings["gone"] else rows

    def _touched(self, settings: dict, keys: DataFrame) -> list[str]:
        """The buckets of the keys: as many as the store has, at most."""
        return [str(r[0]) for r in self._placed(settings, keys).select(BUCKET).distinct().collect()]

    def replace(self, rows: DataFrame, source: str | None = None, batch: int | None = None, gone: DataFrame | None = None, base: int | None = None, whole: bool = False) -> int:
        """The documents of these rows in place of the stored ones; the version then. Batches of a source are applied once.

        ``gone``: keys of documents that lose their stored rows, whether they have new ones or not; ``base``:
        the version to change, the last one if not given. ``whole``: gone has the documents of all rows, which are then read only once.
        """
        base = self.versions()[-1] if base is None else base
        settings = self.manifest(base)
        if source is not None and settings["batches"].get(source, -1) >= batch:
            return base
        key = settings["key"]
        columns = T.StructType.fromJson(json.loads(settings["schema"])).names
        rows = rows.select(*columns)
        rows = rows if whole else rows.persist()
        try:
            own = rows.select(key) if gone is None else gone.select(key) if whole else rows.select(key).unionByName(gone.select(key))
            own = own.distinct().withColumnRenamed(key, "_key")
            touched = self._touched(settings, own.withColumnRenamed("_key", key))
            if not touched:
                return base
            new, old = self._placed(settings, rows), self._placed(settings, self._stored(settings, touched))
            if settings["stamp"] and gone is None:
                both = self._newest(settings, old.unionByName(new))
            else:
                both = old.join(few(own), F.col(key).eqNullSafe(F.col("_key")), "left_anti").unionByName(new)
            folders = {b: f for b, f in settings["folders"].items() if b not in touched} | self._write(both)
            batches = settings["batches"] | ({source: batch} if source is not None else {})
            return self.files.commit(settings | {"folders": folders, "batches": batches})
        finally:
            if not whole:
                rows.unpersist()

    def drop_documents(self, names: DataFrame) -> int:
        """Without the documents of names(key)."""
        return self.replace(self._stored(self.manifest()).limit(0), gone=names)

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests but the last ones, and folders that none of these names; how many folders went."""
        versions = self.versions()
        used = {f.rsplit("/", 1)[0] for v in versions[-keep:] for f in self.manifest(v)["folders"].values()}
        gone = [f"data/{x}" for x in self.files.names("data") if f"data/{x}" not in used]
        for path in [*(f"manifests/{v}.json" for v in versions[:-keep]), *gone]:
            self.files.delete(path)
        return len(gone)
