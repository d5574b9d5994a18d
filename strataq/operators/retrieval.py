"""Regular-expression and token search over text tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.functions.text import strip, tokens
from strataq.operators.ranking import top_per

def lines(files: DataFrame) -> DataFrame:
    """(path, line_number, line) with lines counted from 1."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "line")).select("path", (F.col("i") + 1).cast("long").alias("line_number"), "line")


def matching_lines(files: DataFrame, query: str, most: int = 3) -> DataFrame:
    """The first lines of each file that share a token with the query, with what they share."""
    wanted = tokens(F.lit(query))
    parts = re.findall("[a-z0-9]{2,}", re.sub("([a-z])([A-Z])", r"\1 \2", query).lower().replace("_", " "))
    # a line that shares a token holds its letters in a row: the cheap test first
    near = lines(files).where(F.lower("line").rlike("|".join(parts) if parts else r"\A\z."))
    found = near.withColumn("shared", F.array_sort(F.array_distinct(F.array_intersect(tokens(F.col("line")), wanted)))).where(F.size("shared") > 0)
    first = top_per(found, ["path"], most, F.asc("line_number"))
    return first.select("path", "line_number", F.left(strip(F.col("line")), F.lit(200)).alias("text"), F.array_join("shared", " ").alias("matched"))


def search_lines(files: DataFrame, pattern: str, most: int = 100) -> DataFrame:
    """Lines that match a regular expression, the first ``most`` of each file."""
    found = lines(files).where(F.col("line").rlike(pattern))
    return top_per(found, ["path"], most, F.asc("line_number")).select("path", "line_number", "line")


def search_context(files: DataFrame, pattern: str, context: int = 2, most: int = 100) -> DataFrame:
    """Lines that match, as in ``search_lines``, with up to ``context`` lines before and after each."""
    every = files.select("path", F.split("content", "\n").alias("l"))
    at = F.filter(F.transform("l", lambda x, i: F.when(x.rlike(pattern), i)), lambda i: i.isNotNull())
    hit = every.select("path", "l", F.explode(F.slice(at, 1, most)).alias("i"))
    first = F.greatest(F.lit(0), F.col("i") - context)
    around = lambda lo, n: F.array_join(F.slice("l", lo + 1, n), "\n")
    return hit.select("path", (F.col("i") + 1).cast("long").alias("line_number"), F.get("l", F.col("i")).alias("line"), around(first, F.col("i") - first).alias("before"), around(F.col("i") + 1, F.lit(context)).alias("after"))


def count_lines(files: DataFrame, pattern: str) -> DataFrame:
    """Matching lines of each file that has any."""
    n = F.size(F.filter(F.split("content", "\n"), lambda x: x.rlike(pattern)))
    return files.select("path", n.cast("long").alias("count")).where("count > 0")


def read_bounded(files: DataFrame, most: int = 500, start: int = 1) -> DataFrame:
    """A range of each file's lines, numbered; ``truncated`` is whether the limit was reached."""
    got = F.slice(F.split("content", "\n"), start, most)
    body = F.array_join(F.transform(got, lambda x, i: F.format_string("%6d| %s", i + start, F.regexp_replace(x, r"\s+$", ""))), "\n")
    return files.select("path", body.alias("body"), F.size(got).cast("long").alias("lines_read"), (F.size(got) >= most).alias("truncated"))
