"""Batch twins of the streaming aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.plans import session as P
from strataq.plans.registry import query
from strataq.sources.session import scratch
from strataq.sources.tables import Tables, sql, tool_calls
from strataq.streaming import events as E
from strataq.streaming import sessions as S


@query("tumbling_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def tumbling_counts(t: Tables) -> DataFrame:
    return E.tumbling(t.events)


@query("session_windows", """WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true)::INT AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM s GROUP BY user_id, i""")
def session_windows(t: Tables) -> DataFrame:
    return E.sessions(t.events)


@query("sliding_counts", "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT date_trunc('day', ts) - INTERVAL 1 DAY * unnest([0, 1]) AS s FROM events) GROUP BY 1")
def sliding_counts(t: Tables) -> DataFrame:
    w = t.events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


_REDUCED = f""", ph AS ({{0}}), ca AS ({{1}}), st AS ({{2}})
SELECT 'phase' AS kind, session, started, completed, phase::VARCHAR AS what, NULL::BIGINT AS calls, NULL::BIGINT AS tools FROM ph
UNION ALL SELECT 'call', session, started, ended, concat(tool, ' ', result), NULL, NULL FROM ca
UNION ALL SELECT 'state', session, errors, successes, longest::VARCHAR, calls, tools FROM st"""


@query("session_reducers_stream", sql("tool_events", _REDUCED.format("WITH " + P._TRANSITIONS.strip().lstrip(", "), P._PAIRS, P._STATE)))
def session_reducers_stream(t: Tables) -> DataFrame:
    """Phases, calls and totals of all sessions from a stream in which events come shuffled."""
    folder, events = scratch(t.spark), t.events
    events.repartition(6, F.xxhash64("event_id")).sortWithinPartitions(F.xxhash64("event_id", F.lit(1))).write.parquet(f"{folder}/in")
    # an event of no session, long after all others, lets the watermark pass them
    last = events.agg(F.max("ts").alias("ts")).select(F.col("ts") + F.expr("INTERVAL 3651 DAYS"))
    events.sparkSession.createDataFrame([(None, last.first()[0], -1, None, None, None)], events.schema).write.mode("append").parquet(f"{folder}/in")
    source = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    S.run(tool_calls(source), f"{folder}/out", f"{folder}/checkpoint", phases=dict(P.PHASES), prefixes=P.PREFIXES, other=3, late="3650 days")
    rows = t.spark.read.parquet(f"{folder}/out").where("session >= 0")
    none = F.lit(None).cast("long")
    phases = S.phases(rows).select(F.lit("phase").alias("kind"), "session", "started", "completed", F.col("phase").cast("string").alias("what"), none.alias("calls"), none.alias("tools"))
    calls = S.calls(rows).select(F.lit("call"), "session", "started", "ended", F.concat("tool", F.lit(" "), "result"), none, none)
    states = S.states(rows).select(F.lit("state"), "session", "errors", "successes", F.col("longest").cast("string"), "calls", "tools")
    return phases.union(calls).union(states)
