"""A registry of analysed repositories, kept as a keyed table.

An entry is (alias, path, analyzed_at, indexed, artifact_count). Registering an alias again replaces its entry. Artifacts
are the files directly in a repository's output folder, from a listing of (path) rows; a repository is indexed if
``INDEX`` is among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.sources.versions import VersionedTable

# fixed values: the output folder below a repository, and the artifact that an index leaves
OUTPUT, INDEX = ".code-context", "heuristic_summary.json"


def listing(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length) of all files below folders by a pattern; none of them is opened. Spark passes over hidden folders
    unless the pattern names them: of repositories below ``top`` it is ``top/*/{OUTPUT}``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern).select(F.url_decode("path").alias("path"), "length")


def artifacts(files: DataFrame) -> DataFrame:
    """(path, artifact, n): of each repository the entries of its output folder, a folder there being one entry."""
    parts = F.split("path", f"/{OUTPUT}/", 2)
    found = files.select(parts.alias("p")).where(F.size("p") == 2)
    return found.select(F.element_at("p", 1).alias("path"), F.substring_index(F.element_at("p", 2), "/", 1).alias("artifact")).distinct()


class Registry:
    """The registry below ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.spark = spark
        self.table = VersionedTable(spark, path, ["alias"], buckets)

    def register(self, repositories: DataFrame, files: DataFrame, *, batch: int | None = None) -> bool:
        """Add or replace (alias, path, analyzed_at), of several for one alias the newest. False if ``batch`` was taken
        in before."""
        newest = repositories.groupBy("alias").agg(F.max(F.struct("analyzed_at", "path")).alias("e")).select("alias", "e.path", "e.analyzed_at")
        per = artifacts(files).groupBy(F.col("path").alias("of")).agg(F.count(F.lit(1)).alias("artifact_count"), F.bool_or(F.col("artifact") == INDEX).alias("indexed"))
        entry = newest.join(per, newest["path"].eqNullSafe(per["of"]), "left")
        return self.table.merge(entry.select("alias", "path", "analyzed_at", F.coalesce("indexed", F.lit(False)).alias("indexed"), F.coalesce("artifact_count", F.lit(0)).cast("long").alias("artifact_count")), batch=batch)

    def unregister(self, aliases: DataFrame, *, batch: int | None = None) -> bool:
        return self.table.delete(aliases, batch=batch)

    def entries(self) -> DataFrame:
        found = self.table.read()
        return self.spark.createDataFrame([], "alias string, path string, analyzed_at string, indexed boolean, artifact_count long") if found is None else found

    def by_path(self, paths: DataFrame) -> DataFrame:
        """(path, alias) of those ``paths`` that are registered, the first alias of each."""
        return self.entries().join(paths.select("path").distinct(), "path").groupBy("path").agg(F.min("alias").alias("alias"))
