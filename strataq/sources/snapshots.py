"""Risk snapshots as JSON files, one for each run of an analysis, in the order of their names.

A file holds ``{"timestamp", "overall_risk", "areas": {name: {"risk_level", ...}}}``. Spark names files itself, so a
snapshot that is written here lies in a folder ``snapshot=<name>``; others are known by their file's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_AREA = "struct<risk_level:string,blast_radius:long,churn_rank:long,contributor_count:long,test_coverage:string>"
#: What stands for a missing field of an area.
DEFAULTS = {"risk_level": "medium", "blast_radius": 0, "churn_rank": 0, "contributor_count": 0, "test_coverage": "low"}
SCHEMA = f"timestamp string, overall_risk string, areas map<string,{_AREA}>, _corrupt string"
_OPTIONS = {"multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "recursiveFileLookup": "true"}


def write_snapshots(snapshots: DataFrame, folder: str) -> None:
    """Add a file for each ``seq`` of (area, seq, and fields of an area)."""
    has = [c for c in DEFAULTS if c in snapshots.columns]
    area = F.struct(*has)
    one = snapshots.groupBy("seq").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("area", area)))).alias("areas"))  # the areas of one analysis
    text = F.to_json(F.struct(F.col("seq").alias("timestamp"), F.lit("medium").alias("overall_risk"), "areas"))
    one.select(F.concat(F.lit("risk_"), "seq").alias("snapshot"), text.alias("value")).write.mode("append").partitionBy("snapshot").text(folder)


def _name() -> Column:
    """A snapshot's name from its file's path."""
    path = F.url_decode(F.col("_metadata.file_path"))
    return F.coalesce(F.nullif(F.regexp_extract(path, "/snapshot=([^/]+)/[^/]+$", 1), F.lit("")), F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1))


def _rows(files: DataFrame) -> DataFrame:
    """(file, area, seq, risk_level, churn_rank, contributor_count, test_coverage); a file that is no such snapshot gives one
    row without area."""
    named = files.select(F.col("_metadata.file_path").alias("file"), _name().alias("seq"), "areas", "_corrupt")
    flat = named.select("file", "seq", F.explode_outer(F.when(F.col("_corrupt").isNull(), F.col("areas"))).alias("area", "a"))
    return flat.select("file", "area", "seq", *(F.coalesce(F.col(f"a.{k}"), F.lit(v)).alias(k) for k, v in DEFAULTS.items()))


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark.read.schema(SCHEMA).options(**_OPTIONS).json(folder))


def stream_snapshots(spark: SparkSession, folder: str, *, files_per_batch: int = 1000) -> DataFrame:
    """The same rows as they come in; each file once."""
    return _rows(spark.readStream.schema(SCHEMA).options(**_OPTIONS).option("maxFilesPerTrigger", files_per_batch).json(folder))
