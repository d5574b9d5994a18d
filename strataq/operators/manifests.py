"""Names and versions of dependencies from the lines of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = "[A-Za-z0-9][A-Za-z0-9._-]*+"
#: Lines of a list of requirements: a name, extras, bounds, a marker or remark.
REQUIREMENT = rf"^\s*+({_NAME})\s*+(?:\[[^\]]*+\])?\s*+([=<>!~][^;#]*+)?(?:[;#].*)?$"
#: Lines of a table, and of a list of requirements, in TOML.
TOML_TABLE = rf"""^\s*+["']?({_NAME})["']?\s*+=\s*+["']([^"']*+)["']\s*+(?:#.*)?$"""
TOML_LIST = rf"""^\s*+["']({_NAME})\s*+(?:\[[^\]]*+\])?\s*+([=<>!~][^"';]*+)?(?:;[^"']*+)?["']\s*+,?\s*+(?:#.*)?$"""
#: Lines of an object of names and versions.
PACKAGE = r"""^\s*+"(@?[^"]++)"\s*+:\s*+"([^"]*+)"\s*+,?\s*+$"""


def normal(name: Column) -> Column:
    """Lower case, runs of dots, dashes and underscores as one dash."""
    return F.regexp_replace(F.lower(name), "[-_.]+", "-")


def dependencies(lines: DataFrame) -> DataFrame:
    """``lines`` with ``name`` and ``version`` where a line of ``file`` names a dependency; other lines are left out."""
    file, line = F.col("file"), F.col("line")

    def found(*forms: str) -> Column:
        got = [F.when(line.rlike(f), F.struct(F.regexp_extract(line, f, 1).alias("name"), F.trim(F.regexp_extract(line, f, 2)).alias("version"))) for f in forms]
        return F.coalesce(*got)

    python = F.when(file.endswith(".txt"), found(REQUIREMENT)).when(file.endswith(".toml"), found(TOML_TABLE, TOML_LIST))
    d = F.when(file.endswith(".json"), found(PACKAGE)).otherwise(python)
    rows = lines.withColumn("d", d).where("d IS NOT NULL")
    name = F.when(file.endswith(".json"), F.col("d.name")).otherwise(normal(F.col("d.name")))
    return rows.select(*lines.columns, name.alias("name"), F.nullif(F.col("d.version"), F.lit("")).alias("version"))
