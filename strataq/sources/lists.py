"""Sorted lists as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.sources.session import scratch


def write_sorted(rows: DataFrame, value: Column, folder: str) -> int:
    """Write the distinct values as lines, in order within files and from file to file by their names; returns how many
    there are. Values are dealt by ranges, so no task sees them all."""
    lines = rows.select(value.cast("string").alias("value")).where("value IS NOT NULL").distinct()
    lines.sort("value").write.mode("overwrite").text(folder)
    return rows.sparkSession.read.text(folder).count()


def read_sorted(spark: SparkSession, folder: str) -> DataFrame:
    """(place, value): the lines in the order of their files, counted from 1."""
    name = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    at = spark.read.text(folder).select(name.alias("part"), F.monotonically_increasing_id().alias("id"), "value")
    kept = scratch(spark)  # ids are those of one reading
    at.write.parquet(kept)
    at = spark.read.parquet(kept)
    sizes = at.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).orderBy("part").collect()  # one a file or part of one
    before, starts = 0, []
    for r in sizes:
        starts.append((r["part"]["file"], r["part"]["start"], before - r["first"] + 1))
        before += r["n"]
    moved = spark.createDataFrame(starts, "file string, start long, by long")
    parts = moved.select(F.struct("file", "start").alias("part"), "by")
    return at.join(F.broadcast(parts), "part").select((F.col("id") + F.col("by")).alias("place"), "value")
