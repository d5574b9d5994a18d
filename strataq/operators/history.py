"""Change history: hotspots, co-changes, contributors, ownership."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.operators.ranking import newest, percent, top_per, with_total


def recent() -> tuple[Column, Column]:
    """Newest first; the hash breaks ties of a day."""
    return F.desc("date"), F.desc("hash")


def hotspots(commits: DataFrame, files: Callable[[DataFrame], DataFrame], limit: int = 50, top: int = 30) -> DataFrame:
    """The most often changed files of the newest ``limit`` commits; ``files`` gives the files of some commits. Commits without files use up the window but not
    the denominator; ties go to the file seen first, newest commit first and in path order within it."""
    window = newest(commits.select("hash", "date"), limit, *recent())
    cf = files(window).join(F.broadcast(window.select("hash", "place")), "hash")  # at most ``limit`` rows
    total = cf.agg(F.countDistinct("hash").alias("commit_count"), F.countDistinct("path").alias("unique_files"))
    per = cf.groupBy("path").agg(F.count(F.lit(1)).alias("commits"), F.min("place").alias("seen"))
    out = with_total(per, total).withColumn("percentage", percent(F.col("commits"), F.col("commit_count")))
    return out.orderBy(F.desc("commits"), "seen", "path").limit(top).drop("seen")


def cochanges(commits: DataFrame, files: DataFrame, target: DataFrame, limit: int = 100, top: int = 50) -> DataFrame:
    """Files changed in the newest ``limit`` commits of the one ``target`` path, with their share of these commits."""
    own = files.join(F.broadcast(target.select("path")), "path", "left_semi").select("hash")
    window = newest(commits.select("hash", "date").join(own, "hash", "left_semi"), limit, *recent()).select("hash", "place")
    cf = files.join(F.broadcast(window), "hash").join(F.broadcast(target.select("path")), "path", "left_anti")
    per = cf.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("seen"))
    out = with_total(per, window.agg(F.count(F.lit(1)).alias("total_commits")))
    return out.select("path", F.col("n").alias("count"), percent(F.col("n"), F.col("total_commits")).alias("percentage"), "total_commits", "seen").orderBy(F.desc("count"), "seen", "path").limit(top).drop("seen")


def contributors(commits: DataFrame, limit: int = 100) -> DataFrame:
    """Commits, share, first and last date of each author of the newest ``limit`` commits."""
    window = newest(commits.select("hash", "author", "date"), limit, *recent())
    per = window.groupBy("author").agg(F.count(F.lit(1)).alias("commits"), F.min("date").cast("string").alias("first_commit"), F.max("date").cast("string").alias("last_commit"))
    return per.withColumn("percentage", percent(F.col("commits"), F.sum("commits").over(Window.partitionBy())))


def blame_summary(lines: DataFrame) -> DataFrame:
    """Lines, share and last date of each author of each path (path, author, date)."""
    per = lines.groupBy("path", "author").agg(F.count(F.lit(1)).alias("lines"), F.max("date").cast("string").alias("last_commit_date"))
    return per.withColumn("percentage", percent(F.col("lines"), F.sum("lines").over(Window.partitionBy("path"))))


def cochange_counts(commits: DataFrame, files: DataFrame, sources: DataFrame, limit: int = 100, top: int = 50) -> DataFrame:
    """For each source path the ``top`` files changed along with it in its newest ``limit`` commits (source, target, n)."""
    own = files.join(F.broadcast(sources.select("path")), "path", "left_semi").join(commits.select("hash", "date"), "hash")
    own = top_per(own, ["path"], limit, *recent()).select(F.col("path").alias("source"), "hash", "place")
    both = own.join(files.withColumnRenamed("path", "target"), "hash").where("source <> target")
    per = both.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("seen"))
    return top_per(per, ["source"], top, F.desc("n"), F.asc("seen"), F.asc("target"), name="rank")


def parent(path: Column) -> Column:
    """The folder of a path, '.' at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def folder_sizes(paths: DataFrame, over: int = 5, top: int | None = 20) -> DataFrame:
    """Folders (not the root) with more than ``over`` files, largest first."""
    per = paths.select(parent(F.col("path")).alias("dir")).where("dir <> '.'").groupBy("dir").agg(F.count(F.lit(1)).alias("file_count")).where(F.col("file_count") > over)
    return per if top is None else per.orderBy(F.desc("file_count"), "dir").limit(top)


def bus_factor(commits: DataFrame, files: DataFrame, folders: DataFrame, most: int = 1) -> DataFrame:
    """Folders whose files were changed by at most ``most`` authors, with the display string of the report."""
    who = files.select("hash", parent(F.col("path")).alias("dir")).distinct().join(commits.select("hash", "author"), "hash")
    n = who.groupBy("dir").agg(F.countDistinct("author").alias("contributors")).where(F.col("contributors") <= most)
    return folders.join(n, "dir").withColumn("risk", F.concat("dir", F.lit(" ("), "contributors", F.lit(" contributor, "), "file_count", F.lit(" files)")))


def reviewers(commits: DataFrame, files: DataFrame, changes: DataFrame, first: int = 5, newest_of: int = 10, top: int = 3, key: str = "path") -> DataFrame:
    """For each change the authors of the newest commits of its first files (change_id, identity, reason, confidence, n).
    Files are known by ``key``, which may be shorter than their path."""
    own = top_per(changes, ["change_id"], first, F.asc("path")).select("change_id", key)
    log = top_per(files.join(own.select(key).distinct(), key, "left_semi").join(commits.select("hash", "author", "date"), "hash"), [key], newest_of, *recent()).select(key, "author")
    per = own.join(log, key).groupBy("change_id", F.col("author").alias("identity")).agg(F.count(F.lit(1)).alias("n"))
    out = top_per(per, ["change_id"], top, F.desc("n"), F.asc("identity"))
    reason = F.when(F.col("n") >= 3, "recent_contributor").otherwise("area_expert")
    return out.select("change_id", "identity", reason.alias("reason"), F.least(F.lit(0.9), F.col("n") / 10).alias("confidence"), "n")
