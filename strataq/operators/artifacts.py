"""Counts over JSON artifacts of scanners, whose shapes differ from tool to tool and from run to run.

An artifact is parsed once to VARIANT; text that is no JSON is null and counts nothing. Lists are counted in place and
entries exploded as rows, so no artifact is gathered with others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: levels of findings in order
LEVELS = ["critical", "high", "medium", "low", "info"]


def entries(v: Column, path: str = "$") -> Column:
    """The list at ``path``, null where there is none."""
    return F.try_variant_get(v, path, "array<variant>")


def length(v: Column, path: str = "$") -> Column:
    return F.coalesce(F.array_size(entries(v, path)), F.lit(0)).cast("long")


def type_errors(v: Column) -> Column:
    """A list of diagnostics, or an object with one."""
    return F.when(entries(v).isNotNull(), length(v)).otherwise(length(v, "$.generalDiagnostics"))


def dead_code(v: Column) -> Column:
    """A list, or all lists of an object together."""
    values = F.coalesce(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<variant>"))
    summed = F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + length(x))
    return F.when(entries(v).isNotNull(), length(v)).otherwise(summed)


def findings(artifacts: DataFrame, column: str = "v") -> DataFrame:
    """A row for each entry of an artifact's ``results``, with its level; an unknown or missing one is info."""
    level = F.lower(F.coalesce(F.try_variant_get("entry", "$.extra.severity", "string"), F.lit("info")))
    rows = artifacts.withColumn("entry", F.explode(entries(F.col(column), "$.results")))
    return rows.withColumn("level", F.when(level.isin(LEVELS), level).otherwise("info"))


def functions(artifacts: DataFrame, column: str = "v") -> DataFrame:
    """A row for each function that an artifact of complexities names, with its file and complexity."""
    files = artifacts.select("*", F.explode(F.try_variant_get(column, "$", "map<string,variant>")).alias("file", "list"))
    each = files.withColumn("entry", F.explode(entries(F.col("list")))).drop("list")
    return each.withColumn("complexity", F.try_variant_get("entry", "$.complexity", "double")).where("complexity IS NOT NULL")
