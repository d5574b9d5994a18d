"""Risk-trend queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.operators import risk as R
from strataq.plans.registry import query
from strataq.sources.session import scratch
from strataq.sources.snapshots import read_snapshots, write_snapshots
from strataq.sources.tables import Tables, sql
from strataq.streaming.trends import TrendFollower

_H = """, k AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY seq DESC) AS back FROM risk_snapshots QUALIFY back <= 10),
o AS (SELECT *, list_position(['low', 'medium', 'high', 'critical'], risk_level) - 1 AS risk, list_position(['none', 'low', 'medium', 'high'], test_coverage) - 1 AS coverage FROM k),
l AS (SELECT *, lag(risk) OVER w AS brisk, lag(coverage) OVER w AS bcov, lag(churn_rank) OVER w AS bchurn, lag(contributor_count) OVER w AS bcon FROM o WINDOW w AS (PARTITION BY area ORDER BY seq)),
h AS (SELECT *, sum(CASE WHEN coalesce(risk > brisk, false) THEN 0 ELSE 1 END) OVER (PARTITION BY area ORDER BY seq DESC) AS island FROM l),
st AS (SELECT area, count(*) FILTER (island = 0) AS streak FROM h GROUP BY 1)"""


@query("risk_streak", sql("risk_snapshots", _H + " SELECT area, streak FROM st"))
def risk_streak(t: Tables) -> DataFrame:
    return R.streaks(R.history(t.risk_snapshots()))


_TRENDS = sql("risk_snapshots", _H + """ SELECT area, risk_level AS current_risk, CASE WHEN risk > brisk AND streak >= 3 THEN 'accelerating_risk' WHEN risk > brisk THEN 'degrading' WHEN risk < brisk THEN 'improving' ELSE 'stable' END AS risk_trend,
coalesce((bchurn - churn_rank)::DOUBLE, 0) AS churn_velocity, CASE WHEN contributor_count > bcon THEN 'gaining' WHEN contributor_count < bcon THEN 'losing' ELSE 'stable' END AS contributor_trend,
CASE WHEN coverage > bcov THEN 'improving' WHEN coverage < bcov THEN 'declining' ELSE 'stable' END AS test_coverage_trend,
CASE WHEN brisk IS NULL THEN 'medium' ELSE (['low', 'medium', 'high', 'critical'])[least(3, greatest(0, 2 * risk - brisk)) + 1] END AS projected_risk FROM h JOIN st USING (area) WHERE back = 1""")


@query("risk_trends", _TRENDS)
def risk_trends(t: Tables) -> DataFrame:
    return R.trends(t.risk_snapshots())


@query("risk_projection", sql("risk_snapshots", _H + " SELECT area, seq, risk::BIGINT AS risk, least(3, greatest(0, 2 * risk - brisk))::BIGINT AS projected FROM h"))
def risk_projection(t: Tables) -> DataFrame:
    h = R.history(t.risk_snapshots())
    ahead = F.least(F.lit(3), F.greatest(F.lit(0), 2 * F.col("risk") - F.col("before_risk")))
    return h.select("area", "seq", F.col("risk").cast("long").alias("risk"), ahead.cast("long").alias("projected"))


@query("snapshot_last10", sql("risk_snapshots", _H + " SELECT area, seq, risk_level, back FROM k"))
def snapshot_last10(t: Tables) -> DataFrame:
    return R.history(t.risk_snapshots()).select("area", "seq", "risk_level", F.col("back").cast("long").alias("back"))


@query("risk_snapshot_projection", sql("risk_snapshots", "SELECT area, seq, risk_level, churn_rank, contributor_count, test_coverage FROM risk_snapshots"))
def risk_snapshot_projection(t: Tables) -> DataFrame:
    """Snapshots written as JSON files and read back with their defaults, in the order of the files' names."""
    folder = scratch(t.spark)
    write_snapshots(t.risk_snapshots(), folder)
    return read_snapshots(t.spark, folder).withColumn("seq", F.substring("seq", 6, 10)).drop("file", "blast_radius")


@query("risk_trends_stream", _TRENDS)
def risk_trends_stream(t: Tables) -> DataFrame:
    """The same trends, kept up with a folder to which snapshots are added in two goes, the newer half of them first."""
    folder = scratch(t.spark)
    s = t.risk_snapshots()
    follower = TrendFollower(t.spark, f"{folder}/snapshots", f"{folder}/state", buckets=4)
    for part in ("seq >= '2024-01-16'", "seq < '2024-01-16'"):
        write_snapshots(s.where(part), f"{folder}/snapshots")
        follower.catch_up()
    return follower.trends()
