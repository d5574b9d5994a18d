"""Sections of the summary of a repository, views over them, and what is read from version control's own formats."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.operators.ranking import percent, with_total
from strataq.plans import findings, graph, history, joins, search, trends, verdict
from strataq.plans.registry import ORACLES, query
from strataq.sources.tables import Tables, sql

_DIFF = """WITH d AS (SELECT l_orderkey AS change, string_agg(line, chr(10) ORDER BY l_linenumber) || chr(10) || '+' || chr(10) || ' end' AS diff FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN '--- a' || chr(10) || '+++ b' || chr(10) ELSE '' END || CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE ' ' END || CASE WHEN l_quantity > 45 THEN '' ELSE l_partkey::VARCHAR END AS line FROM lineitem) GROUP BY 1)"""


def diffs(t: Tables) -> DataFrame:
    """(change, diff): a unified diff for each order, some added and removed lines blank."""
    n = F.col("l_linenumber")
    mark = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise(" ")
    line = F.concat(F.when(n == 1, "--- a\n+++ b\n").otherwise(""), mark, F.when(F.col("l_quantity") > 45, "").otherwise(F.col("l_partkey").cast("string")))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("line")))), lambda x: x["line"])  # a few lines an order
    return t.lineitem.groupBy(F.col("l_orderkey").alias("change")).agg(F.concat(F.array_join(lines, "\n"), F.lit("\n+\n end")).alias("diff"))


@query("diff_line_stats", _DIFF + r" SELECT change, len(regexp_extract_all(diff, '(?m)^\+[^+]'))::BIGINT AS additions, len(regexp_extract_all(diff, '(?m)^-[^-]'))::BIGINT AS deletions FROM d")
def diff_line_stats(t: Tables) -> DataFrame:
    """Added and removed lines of a unified diff, its file headers left out. A blank line counts by the line break that
    follows it."""
    count = lambda pattern: F.regexp_count("diff", F.lit(pattern)).cast("long")
    return diffs(t).select("change", count(r"(?m)^\+[^+]").alias("additions"), count("(?m)^-[^-]").alias("deletions"))


_PORCELAIN = """WITH e AS (SELECT DISTINCT l_orderkey AS file, l_linenumber AS n, l_suppkey AS s, l_partkey AS p, (l_linenumber * 10000000 + l_partkey) * 100000 + l_suppkey AS k FROM lineitem),
l AS (SELECT file, 4 * k AS seq, 'deadbeef' AS line FROM e UNION ALL SELECT file, 4 * k + 1, concat('author-mail <s', s % 7, '@x>') FROM e WHERE n % 3 > 0 UNION ALL SELECT file, 4 * k + 2, concat('author-time ', CASE WHEN n % 5 = 0 THEN 'never' ELSE (1600000000 + p * 3600)::VARCHAR END) FROM e UNION ALL SELECT file, 4 * k + 3, chr(9) || 'code' FROM e)"""


def porcelain(t: Tables) -> DataFrame:
    """(file, seq, line): the lines that a blame prints, some entries without author, some with an odd time."""
    n = F.col("l_linenumber")
    k = (n.cast("long") * 10_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")
    parts = F.array(
        F.struct((4 * k).alias("seq"), F.lit("deadbeef").alias("line")),
        F.struct((4 * k + 1).alias("seq"), F.when(n % 3 > 0, F.concat(F.lit("author-mail <s"), F.col("l_suppkey") % 7, F.lit("@x>"))).alias("line")),
        F.struct((4 * k + 2).alias("seq"), F.concat(F.lit("author-time "), F.when(n % 5 == 0, "never").otherwise((F.lit(1_600_000_000) + F.col("l_partkey") * 3600).cast("string"))).alias("line")),
        F.struct((4 * k + 3).alias("seq"), F.lit("\tcode").alias("line")),
    )
    each = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").distinct()
    return each.select(F.col("l_orderkey").alias("file"), F.inline(parts)).where("line IS NOT NULL")


def blame(lines: DataFrame) -> DataFrame:
    """Lines, share and newest date of each author of each file, from (file, seq, line): author and date carry forward to
    the content lines, which begin with a tab; a time that is no number is unknown."""
    w = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    mail = F.when(F.startswith("line", F.lit("author-mail ")), F.regexp_replace(F.substr("line", F.lit(13)), "^[<>]+|[<>]+$", ""))
    time = F.trim(F.substr("line", F.lit(13))).try_cast("long")
    day = F.when(F.startswith("line", F.lit("author-time ")), F.coalesce(F.date_format(F.timestamp_seconds(time), "yyyy-MM-dd"), F.lit("unknown")))
    got = lines.select("file", "line", F.last(mail, ignorenulls=True).over(w).alias("email"), F.coalesce(F.last(day, ignorenulls=True).over(w), F.lit("")).alias("day"))
    per = got.where(F.startswith("line", F.lit("\t")) & (F.col("email") != "")).groupBy("file", "email").agg(F.count(F.lit(1)).alias("lines"), F.max("day").alias("last_commit_date"))
    return per.withColumn("percentage", percent(F.col("lines"), F.sum("lines").over(Window.partitionBy("file"))))


@query("git_blame_porcelain", _PORCELAIN + """, g AS (SELECT file, line, last_value(CASE WHEN starts_with(line, 'author-mail ') THEN trim(line[13:], '<>') END IGNORE NULLS) OVER w AS email,
coalesce(last_value(CASE WHEN starts_with(line, 'author-time ') THEN coalesce(strftime(make_timestamp(TRY_CAST(line[13:] AS BIGINT) * 1000000), '%Y-%m-%d'), 'unknown') END IGNORE NULLS) OVER w, '') AS day FROM l WINDOW w AS (PARTITION BY file ORDER BY seq ROWS UNBOUNDED PRECEDING)),
p AS (SELECT file, email, count(*) AS lines, max(day) AS last_commit_date FROM g WHERE starts_with(line, chr(9)) AND email <> '' GROUP BY 1, 2) SELECT *, round_even(100.0::DOUBLE * lines / sum(lines) OVER (PARTITION BY file), 1) AS percentage FROM p""")
def git_blame_porcelain(t: Tables) -> DataFrame:
    return blame(porcelain(t))


@query("timestamp_slug", "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS slug FROM events")
def timestamp_slug(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("slug"))


#: Days of 400 years.
_CYCLE = 146_097


def iso_day(days: Column) -> Column:
    """Days since 1970 as a date's text, without a sign before years of more than four digits. Any number of days will do:
    the calendar repeats after 400 years, so a date of the first 400 from 1970 on has the month and the day."""
    rest = F.pmod(days, F.lit(_CYCLE))
    cycle, day = ((days - rest) / _CYCLE).cast("long"), F.date_from_unix_date(rest.cast("int"))
    year = F.year(day) + 400 * cycle
    shown = F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    return F.concat(shown, F.date_format(day, "-MM-dd"))


@query("epoch_dates", "SELECT o_orderkey, strftime(make_timestamp(o_custkey * 7919000000000), '%Y-%m-%d') AS day FROM orders")
def epoch_dates(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", iso_day(F.expr("(o_custkey * 39595 - pmod(o_custkey * 39595, 432)) div 432")).alias("day"))  # 7,919,000 s are 39,595 / 432 days


_HEALTH = """SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'medium') AS medium, 0::BIGINT AS low, count(*) FILTER (severity IS NULL OR severity = 'ERROR') AS info,
count(DISTINCT CASE WHEN starts_with(check_id, 'owasp') THEN string_split(check_id, '.')[3] END) AS owasp_categories FROM findings"""


@query("health_section", sql("findings", f"""SELECT h.*, type_errors, lint_violations, dead_code_symbols, avg_complexity FROM ({_HEALTH}) h, (SELECT count(*) FILTER (event_type = 'error') AS type_errors, count(*) FILTER (event_type = 'click') AS lint_violations, count(*) FILTER (event_type = 'signup') AS dead_code_symbols, round_even(avg(value), 2) AS avg_complexity FROM events)"""))
def health_section(t: Tables) -> DataFrame:
    s, parts = F.lower("severity"), F.split("check_id", "[.]")
    level = F.when(s.isin(findings.LEVELS), s).otherwise("info")
    h = t.findings().agg(*(F.count_if(level == x).alias(x) for x in findings.LEVELS), F.countDistinct(F.when(F.startswith("check_id", F.lit("owasp")), F.get(parts, F.lit(2)))).alias("owasp_categories"))
    kind = F.col("event_type")
    rest = t.events.agg(F.count_if(kind == "error").alias("type_errors"), F.count_if(kind == "click").alias("lint_violations"), F.count_if(kind == "signup").alias("dead_code_symbols"), F.bround(F.avg("value"), 2).alias("avg_complexity"))
    return with_total(h, rest)


@query("git_section", sql("commits", f"""SELECT count(*) AS total_commits, count(DISTINCT author) AS contributors, (SELECT string_agg(pair, '; ' ORDER BY count DESC, pair) FROM ({ORACLES['most_coupled_pairs']})) AS coupled_pairs FROM commits"""))
def git_section(t: Tables) -> DataFrame:
    pairs = history.most_coupled_pairs(t).agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "pair"))).alias("p"))  # five rows
    c = t.commits().agg(F.count(F.lit(1)).alias("total_commits"), F.countDistinct("author").alias("contributors"))
    return with_total(c, pairs.select(F.array_join(F.col("p.pair"), "; ").alias("coupled_pairs")))


_SUMMARY = ["volume_stats", "health_section", "git_section"]


@query("heuristic_summary", "SELECT * FROM " + ", ".join(f"({ORACLES[n]})" for n in _SUMMARY) + f""", (SELECT string_agg(concat(lang, '=', files), ', ' ORDER BY lang) AS languages FROM ({ORACLES['detect_languages']})), (SELECT count(*) AS bus_factor_risks FROM ({ORACLES['bus_factor_risks']})),
(SELECT string_agg(concat(community, ' ', symbols), ', ' ORDER BY symbols DESC, community) AS top_communities FROM ({ORACLES['top_communities']})), (SELECT count(*) AS symbol_count, count(DISTINCT s_nationkey) AS community_count FROM supplier), (SELECT edges AS edge_count FROM ({ORACLES['graph_stats']}))""")
def heuristic_summary(t: Tables) -> DataFrame:
    """One record: volume, health, history, communities and the symbol graph."""
    one = with_total(with_total(search.volume_stats(t), health_section(t)), git_section(t))
    langs = search.detect_languages(t).agg(F.array_join(F.array_sort(F.collect_list(F.concat("lang", F.lit("="), "files"))), ", ").alias("languages"))
    top = graph.top_communities(t).agg(F.sort_array(F.collect_list(F.struct((-F.col("symbols")).alias("n"), "community"))).alias("c"))
    top = top.select(F.array_join(F.transform("c", lambda x: F.concat(x["community"], F.lit(" "), -x["n"])), ", ").alias("top_communities"))
    size = t.supplier.agg(F.count(F.lit(1)).alias("symbol_count"), F.countDistinct("s_nationkey").alias("community_count"))
    for part in (langs, history.bus_factor_risks(t).agg(F.count(F.lit(1)).alias("bus_factor_risks")), top, size, graph.graph_stats(t).select(F.col("edges").alias("edge_count"))):
        one = with_total(one, part)  # one row each
    return one


_RECORD = f""", langs AS ({ORACLES['detect_languages']}), fw AS (SELECT DISTINCT framework FROM ({ORACLES['detect_frameworks']})), topf AS ({ORACLES['top_complex_functions']}), bus AS ({ORACLES['bus_factor_risks']}), comm AS ({ORACLES['top_communities']})
SELECT to_json({{'volume': {{'total_files': v.file_count, 'total_lines': v.total_lines, 'estimated_tokens': v.estimated_tokens, 'languages': (SELECT map_from_entries(list((lang, files) ORDER BY lang)) FROM langs), 'frameworks': (SELECT list(framework ORDER BY framework) FROM fw)}},
'health': (SELECT health FROM health), 'git': {{'total_commits_analyzed': g.total_commits, 'active_contributors': g.contributors, 'most_coupled_pairs': string_split(g.coupled_pairs, '; ')}},
'complexity': {{'top_complex_functions': (SELECT list({{'name': name, 'file': file, 'lines': lines, 'complexity': complexity}} ORDER BY complexity DESC, name) FROM topf), 'bus_factor_risks': (SELECT list(risk ORDER BY risk) FROM bus)}},
'graph': {{'indexed': true, 'community_count': (SELECT count(DISTINCT s_nationkey) FROM supplier), 'process_count': (SELECT count(DISTINCT n_regionkey) FROM supplier JOIN nation ON n_nationkey = s_nationkey), 'symbol_count': (SELECT count(*) FROM supplier), 'edge_count': e.edges,
  'top_communities': (SELECT list({{'name': community, 'symbols': symbols, 'cohesion': cohesion}} ORDER BY symbols DESC, community) FROM comm)}}}})::VARCHAR AS record
FROM ({ORACLES['volume_stats']}) v, ({ORACLES['git_section']}) g, ({ORACLES['graph_stats']}) e"""


@query("summary_record", sql("artifacts findings", findings._HEALTH + _RECORD))
def summary_record(t: Tables) -> DataFrame:
    """The summary of a repository as one nested record, written as JSON: sections of numbers, of maps from names to
    numbers, and of lists. Counts are aggregated by name first; only those few rows are put into maps."""
    top = findings.top_complex_functions(t).agg(F.array_sort(F.collect_list(F.struct((-F.col("complexity")).alias("n"), "name", "file", "lines", "complexity"))).alias("f"))  # ten
    near = graph.top_communities(t).agg(F.sort_array(F.collect_list(F.struct((-F.col("symbols")).alias("n"), F.col("community").alias("name"), "symbols", "cohesion"))).alias("c"))  # ten
    langs = search.detect_languages(t).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "files")))).alias("languages"))
    region = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    size = t.supplier.join(F.broadcast(region), "s_nationkey").agg(F.countDistinct("s_nationkey").alias("community_count"), F.countDistinct("n_regionkey").alias("process_count"), F.count(F.lit(1)).alias("symbol_count"))  # a table of fixed size
    one = search.volume_stats(t).withColumnRenamed("file_count", "total_files")
    for part in (
        langs, joins.detect_frameworks(t).agg(F.sort_array(F.collect_set("framework")).alias("frameworks")), findings.health(t), git_section(t).withColumnRenamed("contributors", "active_contributors"), top,
        history.bus_factor_risks(t).agg(F.sort_array(F.collect_list("risk")).alias("bus_factor_risks")), size, graph.graph_stats(t).select(F.col("edges").alias("edge_count")), near,
    ):
        one = with_total(one, part)  # one row each
    pick = lambda x, *names: F.struct(*(x[n].alias(n) for n in names))
    record = F.struct(
        F.struct("total_files", "total_lines", "estimated_tokens", "languages", "frameworks").alias("volume"),
        "health",
        F.struct(F.col("total_commits").alias("total_commits_analyzed"), "active_contributors", F.split("coupled_pairs", "; ").alias("most_coupled_pairs")).alias("git"),
        F.struct(F.transform("f", lambda x: pick(x, "name", "file", "lines", "complexity")).alias("top_complex_functions"), "bus_factor_risks").alias("complexity"),
        F.struct(F.lit(True).alias("indexed"), "community_count", "process_count", "symbol_count", "edge_count", F.transform("c", lambda x: pick(x, "name", "symbols", "cohesion")).alias("top_communities")).alias("graph"),
    )
    return one.select(F.to_json(record).alias("record"))


# fixed values: the names of the scanners' views
SCANNERS = ["all", "semgrep", "typecheck", "lint", "complexity", "dead_code"]
_SCANS = {
    "all": f"SELECT 'all' AS scanner, u.item, u.n FROM (UNPIVOT (SELECT critical, high, medium, low, info, type_errors, lint_violations, dead_code_symbols FROM ({ORACLES['health_section']})) ON COLUMNS(*) INTO NAME item VALUE n) u",
    "semgrep": f"SELECT 'semgrep', level, count FROM ({ORACLES['severity_counts']})",
    "typecheck": "SELECT 'typecheck', event_id::VARCHAR, 1 FROM events WHERE event_type = 'error'",
    "lint": "SELECT 'lint', event_id::VARCHAR, 1 FROM events WHERE event_type = 'click'",
    "complexity": "SELECT 'complexity', event_id::VARCHAR, floor(value)::BIGINT FROM events",
    "dead_code": "SELECT 'dead_code', event_id::VARCHAR, 1 FROM events WHERE event_type = 'signup'",
}


def static_scan(t: Tables, scanner: str = "all") -> DataFrame:
    """(scanner, item, n) of one scanner's findings, or of the summary of all; an unknown name is an error."""
    kinds = {"typecheck": "error", "lint": "click", "dead_code": "signup"}
    if scanner == "all":
        counts = ["critical", "high", "medium", "low", "info", "type_errors", "lint_violations", "dead_code_symbols"]
        out = health_section(t).select(*counts).unpivot([], counts, "item", "n")
    elif scanner == "semgrep":
        out = findings.severity_counts(t).toDF("item", "n")
    elif scanner in kinds:
        out = t.events.where(F.col("event_type") == kinds[scanner]).select(F.col("event_id").cast("string").alias("item"), F.lit(1).cast("long").alias("n"))
    elif scanner == "complexity":
        out = t.events.select(F.col("event_id").cast("string").alias("item"), F.floor("value").alias("n"))
    else:
        raise ValueError(f"unknown scanner {scanner!r}; valid: {', '.join(SCANNERS)}")
    return out.select(F.lit(scanner).alias("scanner"), "item", F.col("n").cast("long").alias("n"))


@query("static_scan_findings", " UNION ALL ".join(_SCANS[s] for s in SCANNERS))
def static_scan_findings(t: Tables) -> DataFrame:
    """All views one after the other."""
    out = static_scan(t, SCANNERS[0])
    for s in SCANNERS[1:]:
        out = out.unionByName(static_scan(t, s))
    return out


def or_else(rows: DataFrame, instead: DataFrame) -> DataFrame:
    """``rows``, or where there are none those of ``instead``, with a column ``source``."""
    none = rows.limit(1).agg(F.count(F.lit(1)).alias("some"))
    other = with_total(instead, none).where("some = 0").drop("some")
    return rows.withColumn("source", F.lit("own")).unionByName(other.withColumn("source", F.lit("summary")))


def git_evolution(t: Tables, analysis: str = "summary") -> DataFrame:
    """A view of the history by name; those without rows of their own fall back to the summary's."""
    blank = lambda c: F.lit(None).cast("string").alias(c)
    if analysis == "summary":
        return git_section(t)
    if analysis == "hotspots":
        return or_else(history.index_hotspots(t).select("path", "commits"), git_section(t).select(blank("path"), F.col("total_commits").alias("commits")))
    if analysis == "coupling":
        return or_else(history.cochange_top10(t).select("source", "target", "count").withColumnRenamed("source", "of"), history.most_coupled_pairs(t).select(F.col("source").alias("of"), "target", "count"))
    if analysis == "contributors":
        c = t.commits().agg(F.countDistinct("author").alias("active_contributors"), F.count(F.lit(1)).alias("total_commits"))
        return with_total(c, history.bus_factor_risks(t).agg(F.count(F.lit(1)).alias("bus_factor_risks")))
    raise ValueError(f"unknown analysis {analysis!r}; valid: hotspots, coupling, contributors, summary")


@query("git_evolution_summary", ORACLES["git_section"])
def git_evolution_summary(t: Tables) -> DataFrame:
    return git_evolution(t)


@query("git_evolution_hotspots", f"SELECT path, commits, 'own' AS source FROM ({ORACLES['index_hotspots']})")
def git_evolution_hotspots(t: Tables) -> DataFrame:
    return git_evolution(t, "hotspots")


@query("git_evolution_coupling", f"SELECT source AS of, target, count, 'own' AS source FROM ({ORACLES['cochange_top10']})")
def git_evolution_coupling(t: Tables) -> DataFrame:
    return git_evolution(t, "coupling")


@query("git_evolution_bus_factor", sql("commits", f"SELECT count(DISTINCT author) AS active_contributors, count(*) AS total_commits, (SELECT count(*) FROM ({ORACLES['bus_factor_risks']})) AS bus_factor_risks FROM commits"))
def git_evolution_bus_factor(t: Tables) -> DataFrame:
    return git_evolution(t, "contributors")


#: Views of an analysis by name.
VIEWS: dict[str, Callable[[Tables], DataFrame]] = {
    "summary": summary_record, "verdict": verdict.compute_verdict, "signals": verdict.change_signals, "labels": verdict.suggest_labels, "comment": verdict.review_comment, "trends": trends.risk_trends,
    **{f"scan/{s}": partial(static_scan, scanner=s) for s in SCANNERS}, **{f"git/{a}": partial(git_evolution, analysis=a) for a in ("summary", "hotspots", "coupling", "contributors")},
}


def view(t: Tables, name: str) -> DataFrame:
    """A view by name; an unknown name is an error that tells the known ones."""
    if name not in VIEWS:
        raise ValueError(f"unknown view {name!r}; valid: {', '.join(sorted(VIEWS))}")
    return VIEWS[name](t)


@query("summary_views", f"SELECT 'git/contributors' AS view, total_commits AS n FROM ({ORACLES['git_evolution_bus_factor']}) UNION ALL SELECT 'scan/semgrep', sum(count)::BIGINT FROM ({ORACLES['severity_counts']}) UNION ALL SELECT 'trends', count(*) FROM ({ORACLES['risk_trends']})")
def summary_views(t: Tables) -> DataFrame:
    """One number of each of some views, asked for by name."""
    parts = [("git/contributors", F.max("total_commits")), ("scan/semgrep", F.sum("n")), ("trends", F.count(F.lit(1)))]
    out = [view(t, name).agg(n.alias("n")).select(F.lit(name).alias("view"), "n") for name, n in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])
