"""Tool-call sessions, phases and conversations as windows over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.functions.text import cut
from strataq.operators.ranking import top_per
from strataq.plans.registry import query
from strataq.sources.tables import Tables, sql

# fixed values: tools and their phases; tools that may fail
PHASES = [("read_heuristic_summary", 2), ("dispatch_team", 3), ("rg_search", 3), ("shell", 3), ("git_hotspots", 3), ("read_team_findings", 4), ("write_bundle", 5)]
EXEMPT = ["rg_search", "context7_resolve-library-id", "context7_query-docs", "shell"]
PREFIXES = r"^(gitnexus_|context7_)"
_PHASE = "CASE tool WHEN 'read_heuristic_summary' THEN 2 WHEN 'dispatch_team' THEN 3 WHEN 'rg_search' THEN 3 WHEN 'shell' THEN 3 WHEN 'git_hotspots' THEN 3 WHEN 'read_team_findings' THEN 4 WHEN 'write_bundle' THEN 5 ELSE CASE WHEN regexp_matches(tool, '^(gitnexus_|context7_)') THEN 3 END END"


def with_phase(t: Tables, events: DataFrame) -> DataFrame:
    known = F.broadcast(t.literal("tool string, known int", PHASES))  # a few rows
    return events.join(known, "tool", "left").withColumn("phase", F.coalesce("known", F.when(F.col("tool").rlike(PREFIXES), 3))).drop("known")


@query("resolve_phase", sql("tool_events", f"SELECT tool, {_PHASE} AS phase, count(*) AS n FROM tool_events GROUP BY 1, 2"))
def resolve_phase(t: Tables) -> DataFrame:
    return with_phase(t, t.tool_events()).groupBy("tool", "phase").agg(F.count(F.lit(1)).alias("n"))


_TRANSITIONS = f""", p AS (SELECT session, seq, {_PHASE} AS phase FROM tool_events),
m AS (SELECT *, max(phase) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p WHERE phase IS NOT NULL)
SELECT session, phase, seq AS started, lead(seq) OVER (PARTITION BY session ORDER BY seq) AS completed FROM m WHERE best IS NULL OR phase > best"""


@query("phase_transitions", sql("tool_events", _TRANSITIONS))
def phase_transitions(t: Tables) -> DataFrame:
    """A phase begins with the first event above all earlier ones and ends where the next begins."""
    w = Window.partitionBy("session").orderBy("seq")
    p = with_phase(t, t.tool_events()).where("phase IS NOT NULL")
    p = p.withColumn("best", F.max("phase").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("best IS NULL OR phase > best")
    return p.select("session", "phase", F.col("seq").alias("started"), F.lead("seq").over(w).alias("completed"))


@query("discovery_ring", sql("tool_events", "SELECT session, seq, tool FROM tool_events WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq DESC) <= 20"))
def discovery_ring(t: Tables) -> DataFrame:
    return top_per(t.tool_events().where("status = 'completed'"), ["session"], 20, F.desc("seq")).select("session", "seq", "tool")


@query("recent_tools", sql("tool_events", "SELECT session, string_agg(tool, ',' ORDER BY seq) AS tools FROM (SELECT * FROM tool_events QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq DESC) <= 5) GROUP BY 1"))
def recent_tools(t: Tables) -> DataFrame:
    last = top_per(t.tool_events(), ["session"], 5, F.desc("seq"))
    ordered = F.sort_array(F.collect_list(F.struct("seq", "tool")))
    return last.groupBy("session").agg(F.array_join(F.transform(ordered, lambda x: x["tool"]), ",").alias("tools"))


_KIND = "CASE WHEN contains(tool, '_') THEN concat(string_split(tool, '_')[1], '_*') ELSE tool END"


def kind(tool: Column) -> Column:
    return F.when(F.contains(tool, F.lit("_")), F.concat(F.substring_index(tool, "_", 1), F.lit("_*"))).otherwise(tool)


@query("tool_stats", sql("tool_events", f"SELECT {_KIND} AS kind, count(*) AS n FROM tool_events GROUP BY 1"))
def tool_stats(t: Tables) -> DataFrame:
    return t.tool_events().groupBy(kind(F.col("tool")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("tool_summary", sql("tool_events", f"SELECT session, kind, n, ok FROM (SELECT session, {_KIND} AS kind, count(*) AS n, count(*) FILTER (status <> 'error') AS ok FROM tool_events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY session ORDER BY n DESC, kind) <= 5"))
def tool_summary(t: Tables) -> DataFrame:
    per = t.tool_events().groupBy("session", kind(F.col("tool")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "error").alias("ok"))
    return top_per(per, ["session"], 5, F.desc("n"), F.asc("kind")).drop("place")


_PAIRS = "SELECT session, seq AS started, lead(seq) OVER w AS ended, tool, left(lead(result) OVER w, 20) AS result FROM tool_events WINDOW w AS (PARTITION BY session ORDER BY seq) QUALIFY row_number() OVER w % 2 = 1 AND ended IS NOT NULL"


@query("tool_call_pairs", sql("tool_events", _PAIRS))
def tool_call_pairs(t: Tables) -> DataFrame:
    """Odd events start the single active call, even ones end it."""
    w = Window.partitionBy("session").orderBy("seq")
    p = t.tool_events().select("session", F.col("seq").alias("started"), F.lead("seq").over(w).alias("ended"), "tool", F.left(F.lead("result").over(w), F.lit(20)).alias("result"), F.row_number().over(w).alias("i"))
    return p.where("i % 2 = 1 AND ended IS NOT NULL").drop("i")


@query("team_sessions", sql("tool_events", """, s AS (SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY seq) AS i FROM tool_events WHERE tool = 'dispatch_team'),
e AS (SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY seq) AS i FROM tool_events WHERE tool = 'read_team_findings')
SELECT s.session, s.i AS team, s.seq AS started, e.seq AS completed FROM s LEFT JOIN e USING (session, i)"""))
def team_sessions(t: Tables) -> DataFrame:
    w = Window.partitionBy("session").orderBy("seq")

    def numbered(tool: str, name: str) -> DataFrame:
        return t.tool_events().where(F.col("tool") == tool).select("session", F.col("seq").alias(name), F.row_number().over(w).cast("long").alias("team"))

    return numbered("dispatch_team", "started").join(numbered("read_team_findings", "completed"), ["session", "team"], "left")


_STATE = "SELECT session, count(*) AS calls, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'completed') AS successes, max(length(result))::BIGINT AS longest, count(DISTINCT tool) AS tools FROM tool_events GROUP BY 1"


@query("session_state", sql("tool_events", _STATE))
def session_state(t: Tables) -> DataFrame:
    return t.tool_events().groupBy("session").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "completed").alias("successes"), F.max(F.length("result")).cast("long").alias("longest"), F.countDistinct("tool").alias("tools"))


_ERR = "(contains(result, '\"status\": \"error\"') OR contains(result, '\"status\":\"error\"'))"


@query("error_result_filter", sql("tool_events", f"SELECT seq, tool FROM tool_events WHERE {_ERR}"))
def error_result_filter(t: Tables) -> DataFrame:
    r = F.col("result")
    return t.tool_events().where(r.contains('"status": "error"') | r.contains('"status":"error"')).select("seq", "tool")


@query("failfast_violations", sql("tool_events", "SELECT seq, tool, coalesce(json_extract_string(result, '$.error'), json_extract_string(result, '$.message'), 'unknown error') AS message FROM tool_events WHERE tool NOT IN ('rg_search', 'context7_resolve-library-id', 'context7_query-docs', 'shell') AND NOT regexp_matches(tool, '^(gitnexus_|context7_)') AND json_extract_string(result, '$.status') = 'error'"))
def failfast_violations(t: Tables) -> DataFrame:
    e = t.tool_events().where(~F.col("tool").isin(EXEMPT) & ~F.col("tool").rlike(PREFIXES) & (F.get_json_object("result", "$.status") == "error"))
    return e.select("seq", "tool", F.coalesce(F.get_json_object("result", "$.error"), F.get_json_object("result", "$.message"), F.lit("unknown error")).alias("message"))


_COMMAND = "CASE event_id % 6 WHEN 0 THEN concat('grep -r x', user_id) WHEN 1 THEN concat('rg foo | cat ', user_id) WHEN 2 THEN 'tree src' WHEN 3 THEN concat('find . -name u', user_id) WHEN 4 THEN concat('cat file', user_id) ELSE 'git log' END"


def commands(t: Tables) -> DataFrame:
    i, u = F.col("event_id") % 6, F.col("user_id")
    c = F.when(i == 0, F.concat(F.lit("grep -r x"), u)).when(i == 1, F.concat(F.lit("rg foo | cat "), u)).when(i == 2, "tree src").when(i == 3, F.concat(F.lit("find . -name u"), u)).when(i == 4, F.concat(F.lit("cat file"), u)).otherwise("git log")
    return t.events.select("event_id", c.alias("command"))


@query("tool_alternative_suggest", f"SELECT event_id, CASE WHEN contains(c, 'grep') THEN 'rg_search' WHEN contains(c, 'rg ') THEN 'rg_search' WHEN contains(c, 'cat ') THEN 'read_file_bounded' WHEN contains(c, 'tree ') THEN 'create_file_manifest (never run tree on repo root)' WHEN contains(c, 'find ') THEN 'create_file_manifest or rg_search' END AS suggestion FROM (SELECT event_id, {_COMMAND} AS c FROM events)")
def tool_alternative_suggest(t: Tables) -> DataFrame:
    # fixed values: words of a shell command, in order, and the tool to use instead
    better = [("grep", "rg_search"), ("rg ", "rg_search"), ("cat ", "read_file_bounded"), ("tree ", "create_file_manifest (never run tree on repo root)"), ("find ", "create_file_manifest or rg_search")]
    out = F.lit(None).cast("string")
    for word, tool in reversed(better):
        out = F.when(F.col("command").contains(word), tool).otherwise(out)
    return commands(t).select("event_id", out.alias("suggestion"))


@query("oversized_output", "SELECT page_id, length(html) AS size, length(html) > 10000 AS oversized FROM pages")
def oversized_output(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.length("html").cast("long").alias("size"), (F.length("html") > 10_000).alias("oversized"))


@query("json_event_log", sql("tool_events", "SELECT seq, tool, CASE WHEN status = 'error' THEN 'error' ELSE 'ok' END AS status FROM tool_events"))
def json_event_log(t: Tables) -> DataFrame:
    """Events as JSON lines and back."""
    line = F.to_json(F.struct("seq", "tool", F.when(F.col("status") == "error", "error").otherwise("ok").alias("status")))
    return t.tool_events().select(F.from_json(line, "seq long, tool string, status string").alias("e")).select("e.*")


@query("discovery_extract", sql("tool_events", "SELECT seq, concat(json_extract_string(result, '$.file_count'), ' files') AS summary FROM tool_events WHERE json_extract_string(result, '$.status') <> 'error' AND json_extract_string(result, '$.file_count') IS NOT NULL"))
def discovery_extract(t: Tables) -> DataFrame:
    n = F.get_json_object("result", "$.file_count")
    return t.tool_events().where((F.get_json_object("result", "$.status") != "error") & n.isNotNull()).select("seq", F.concat(n, F.lit(" files")).alias("summary"))


@query("tool_info_label", sql("tool_events", "SELECT seq, coalesce(json_extract_string(result, '$.file_count'), json_extract_string(result, '$.count'), left(json_extract_string(result, '$.message'), 40)) AS label FROM tool_events"))
def tool_info_label(t: Tables) -> DataFrame:
    get = lambda k: F.get_json_object("result", f"$.{k}")
    return t.tool_events().select("seq", F.coalesce(get("file_count"), get("count"), F.left(get("message"), F.lit(40))).alias("label"))


@query("conversation_compaction", """SELECT conv_id, turn, role, CASE WHEN row_number() OVER w <= count(*) OVER (PARTITION BY conv_id) - 4 AND length(text) > 400 THEN concat('[Tool output consumed (', length(text), ' chars) — see reasoning above]') ELSE text END AS text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def conversation_compaction(t: Tables) -> DataFrame:
    """Long texts before a conversation's last four messages give way to a stub."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t.messages().withColumn("i", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    stub = F.concat(F.lit("[Tool output consumed ("), F.length("text"), F.lit(" chars) — see reasoning above]"))
    return c.select("conv_id", "turn", "role", F.when((F.col("i") <= F.col("n") - 4) & (F.length("text") > 400), stub).otherwise(F.col("text")).alias("text"))


@query("command_summary", "SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error' AND value < 20) AS success, count(*) FILTER (NOT (event_type <> 'error' AND value < 20)) AS failed FROM events GROUP BY 1")
def command_summary(t: Tables) -> DataFrame:
    """A command succeeds with exit code 0 (no error) and nothing on stderr (here: a small value)."""
    ok = (F.col("event_type") != "error") & (F.col("value") < 20)
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"))


def truncated(out: Column, err: Column, most_out: int = 100_000, most_err: int = 10_000) -> tuple[Column, Column]:
    """What a command printed, each stream cut with a marker."""
    return cut(out, most_out, "\n... [truncated]"), cut(err, most_err, "\n... [truncated]")


@query("truncate_output", "SELECT page_id, md5(CASE WHEN length(o) > 100000 THEN concat(left(o, 100000), chr(10), '... [truncated]') ELSE o END) AS out, md5(CASE WHEN length(e) > 10000 THEN concat(left(e, 10000), chr(10), '... [truncated]') ELSE e END) AS err FROM (SELECT page_id, repeat(html, 50) AS o, repeat(url, 300) AS e FROM pages)")
def truncate_output(t: Tables) -> DataFrame:
    out, err = truncated(F.repeat("html", F.lit(50)), F.repeat("url", F.lit(300)))
    return t.pages.select("page_id", F.md5(out).alias("out"), F.md5(err).alias("err"))
