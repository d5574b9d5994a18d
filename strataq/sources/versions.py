"""A keyed Parquet table that is merged into, in the shared folder or any other that Spark can reach.

Rows lie in a fixed number of buckets by the hash of their keys. A merge reads only the buckets that its updates touch,
writes these beside the old ones, and then names, in a manifest of one row for each bucket, which folder holds each bucket
now. Manifests are written to a staging folder and renamed into place, so a reader sees a merge whole or not at all,
and what a failed merge has written is never read. A merge may carry the number of its batch: one that was applied
already changes nothing, so a retried batch is safe. There is one writer at a time; a second finds its version taken and
fails.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.sources.session import materialize

_MANIFEST = "bucket int, place string, batch long, schema string"
#: The manifest's row that is of no bucket: it carries the batch and the schema.
_HEAD = -1


class VersionedTable:
    """Rows known by ``keys`` below ``path``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str) -> JavaObject:
        return self._hadoop("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        """Numbers of the manifests that are there."""
        folder = self._at("manifests")
        return sorted(int(f.getPath().getName()) for f in self._files.listStatus(folder)) if self._files.exists(folder) else []

    @property
    def version(self) -> int:
        """0 before the first merge."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> tuple[dict[int, str], int | None, str | None]:
        """(folder of each bucket, number of the last batch, schema): one small row a bucket."""
        if not version:
            return {}, None, None
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifests/{version}").collect()
        head = next(r for r in rows if r["bucket"] == _HEAD)
        return {r["bucket"]: r["place"] for r in rows if r["bucket"] != _HEAD}, head["batch"], head["schema"]

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The table as of a version (the newest); none before the first merge."""
        places, _, schema = self._manifest(self.version if version is None else version)
        return None if schema is None else self._of(places, schema, buckets)

    def _of(self, places: dict[int, str], schema: str, buckets: list[int] | None) -> DataFrame:
        paths = [f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(places.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, updates: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None, *, batch: int | None = None) -> bool:
        """Put ``combine(old, updates)`` in the place of the touched buckets' rows; without it an update replaces the row
        of its keys (of updates with equal keys an arbitrary one). False if ``batch`` was applied before."""
        before = self.version
        places, last, schema = self._manifest(before)
        if batch is not None and last is not None and batch <= last:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        staged = materialize(updates.withColumn("bucket", bucket))
        touched = [r["bucket"] for r in staged.select("bucket").distinct().collect()]  # at most ``buckets``
        updates = staged.drop("bucket")
        old = self._of(places, schema, touched) if schema is not None else self.spark.createDataFrame([], updates.schema)
        new = (combine or self.replaced)(old, updates)
        version = before + 1
        place = f"{version}-{uuid.uuid4().hex}"  # of this try alone
        data = f"{self.path}/data/{place}"
        if touched:
            new.withColumn("bucket", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(data)
        places = {b: v for b, v in places.items() if b not in touched} | {b: place for b in touched if self._files.exists(self._hadoop(f"{data}/bucket={b}"))}
        self._commit(version, places, batch if batch is not None else last, new.schema.json())
        return True

    def without(self, old: DataFrame, gone: DataFrame) -> DataFrame:
        """The rows of ``old`` whose keys are not among those of ``gone``; none is a key like others."""
        keys = gone.select(*(F.col(k).alias(f"_gone_{k}") for k in self.keys))
        same = [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in self.keys]
        return old.join(keys, functools.reduce(Column.__and__, same), "left_anti")

    def replaced(self, old: DataFrame, updates: DataFrame) -> DataFrame:
        return self.without(old, updates).unionByName(updates.dropDuplicates(self.keys))

    def delete(self, keys: DataFrame, *, batch: int | None = None) -> bool:
        """Take out the rows of ``keys``."""
        return self.merge(keys.select(*self.keys), self.without, batch=batch)

    def _commit(self, version: int, places: dict[int, str], batch: int | None, schema: str) -> None:
        staging, target = f"{self.path}/staging/{uuid.uuid4().hex}", self._at("manifests", str(version))
        rows = [(_HEAD, None, batch, _ddl(self.spark, schema)), *((b, v, None, None) for b, v in sorted(places.items()))]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.json(staging)
        self._files.mkdirs(self._at("manifests"))
        if self._files.exists(target) or not self._files.rename(self._hadoop(staging), target):
            raise RuntimeError(f"version {version} of {self.path} was written by another merge")

    def vacuum(self, keep: int = 2) -> None:
        """Delete all manifests but the newest ``keep``, and the data of their versions that these don't name."""
        kept = self.versions()[-keep:]
        used = {place for m in kept for place in self._manifest(m)[0].values()}
        for version in self.versions()[: -len(kept)]:
            self._files.delete(self._at("manifests", str(version)), True)
        data = self._at("data")
        for f in self._files.listStatus(data) if self._files.exists(data) else []:
            place = f.getPath().getName()
            if place not in used and int(place.partition("-")[0]) <= max(kept, default=0):
                self._files.delete(f.getPath(), True)


def _ddl(spark: SparkSession, schema: str) -> str:
    return spark.sparkContext._jvm.org.apache.spark.sql.types.DataType.fromJson(schema).toDDL()
