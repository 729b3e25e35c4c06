"""A store of papers that takes single papers in: buckets by hash of the key, and manifests that say which files are valid.

A write rewrites the buckets that its papers fall into, as new files beside the old ones, and then puts one small manifest in place that names, for each bucket, its files. Readers
take the manifest of the highest number, so they see the store before or after a write and nothing between; a write that fails, in a task or on the driver, leaves files that
no manifest names. The file system lets one writer create a manifest of a number, so of two writers that began from one state the second raises Conflict and can begin again. The manifest before stays as a backup until `swept`.

Defined results: of incoming papers with one key the one of the greatest content hash counts; papers without a key raise an error; an empty write changes nothing; a folder without a manifest is an empty store.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.papers import FIELDS

#: Buckets of a new store: a fixed number, written in its manifests.
BUCKETS = 256
SCHEMA = "key string, " + ", ".join(f"{n} {k}" for n, k in FIELDS.items())


class Conflict(RuntimeError):
    """Another write came first."""


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.new = {"number": 0, "buckets": buckets, "files": {}}

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    @property
    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Numbers of the manifests that are there."""
        folder = self._path("manifests")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> dict:
        """The latest manifest, or that of a number."""
        known = self.numbers()
        if not known:
            return self.new
        stream = self._files.open(self._path(f"manifests/{known[-1] if number is None else number}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _put(self, manifest: dict) -> None:
        """The manifest under its number, whole or not at all: written aside, then renamed to a name that nobody has."""
        aside, to = self._path(f"aside/{uuid.uuid4().hex}"), self._path(f"manifests/{manifest['number']}.json")
        self._files.mkdirs(self._path("manifests"))
        out = self._files.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        # HDFS and stores of its kind refuse to rename over a file; a claim makes it so everywhere
        claim = self._path(f"claims/{manifest['number']}")
        try:
            self._files.create(claim, False).close()
        except Exception as e:  # noqa: BLE001  the kinds of errors differ by file system
            raise Conflict(f"write {manifest['number']} was begun by another") from e
        if not self._files.rename(aside, to):
            raise Conflict(f"write {manifest['number']} was done by another")

    def bucket(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def read(self, number: int | None = None) -> DataFrame:
        """All papers, or those of an earlier manifest that is still there."""
        return self._of(self.manifest(number), None)

    def paper(self, key: str) -> DataFrame:
        """One paper; only its bucket is read."""
        now = self.manifest()
        (one,) = self.spark.range(1).select(self.bucket(F.lit(key), now["buckets"])).first()
        return self._of(now, [one]).filter(F.col("key") == key)

    def _of(self, manifest: dict, buckets: list[int] | None) -> DataFrame:
        paths = [f"{self.folder}/data/{v}/bucket={b}" for b, v in manifest["files"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def write(self, papers: DataFrame) -> int:
        """Take papers in (key and FIELDS; those that are there are replaced) and give the number of the store's new state."""
        now = self.manifest()
        known = F.when(F.col("key").isNotNull(), F.col("key")).otherwise(F.raise_error(F.lit("a paper without a key")).cast("string"))
        rows = papers.select(known.alias("key"), *FIELDS)
        named = rows.select(F.struct("*").alias("p"), F.xxhash64(F.to_json(F.struct("*"))).alias("h"))
        incoming = named.groupBy(F.col("p.key").alias("key")).agg(F.max_by("p", "h").alias("p")).select("p.*").withColumn("bucket", self.bucket(F.col("key"), now["buckets"]))
        touched = sorted(r[0] for r in rows.select(self.bucket(F.col("key"), now["buckets"])).distinct().collect())  # as many as buckets at most
        if not touched:
            return now["number"]
        before = self._of(now, touched).withColumn("bucket", self.bucket(F.col("key"), now["buckets"]))
        stay = before.join(incoming.select("key"), "key", "left_anti")
        version = uuid.uuid4().hex
        incoming.unionByName(stay).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data/{version}")
        after = {"number": now["number"] + 1, "buckets": now["buckets"], "files": now["files"] | {str(b): version for b in touched}}
        self._put(after)
        return after["number"]

    def released(self) -> None:
        """Without the claim of a writer that died between its claim and its manifest; only when none is at work."""
        self._files.delete(self._path(f"claims/{self.manifest()['number'] + 1}"), False)

    def swept(self, keep: int = 2) -> None:
        """Without the files that none of the last manifests names; not while others write."""
        numbers = self.numbers()
        valid = {v for n in numbers[-keep:] for v in self.manifest(n)["files"].values()}
        for n in numbers[:-keep]:
            self._files.delete(self._path(f"manifests/{n}.json"), False)
        data = self._path("data")
        for s in self._files.listStatus(data) if self._files.exists(data) else []:
            if s.getPath().getName() not in valid:
                self._files.delete(s.getPath(), True)
        self._files.delete(self._path("aside"), True)
