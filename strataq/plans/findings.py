"""Scanner findings and semi-structured artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.operators import artifacts as A
from strataq.operators.ranking import percent, with_total
from strataq.plans.registry import query
from strataq.sources.tables import Tables, sql

LEVELS = A.LEVELS


@query("severity_counts", sql("findings", """, s AS (SELECT CASE WHEN lower(coalesce(severity, 'info')) IN ('critical', 'high', 'medium', 'low') THEN lower(severity) ELSE 'info' END AS level FROM findings)
SELECT l AS level, (SELECT count(*) FROM s WHERE level = l) AS count FROM (SELECT unnest(['critical', 'high', 'medium', 'low', 'info']) AS l)"""))
def severity_counts(t: Tables) -> DataFrame:
    level = F.lower(F.coalesce("severity", F.lit("info")))
    n = t.findings().agg(*(F.count_if(F.when(level.isin(LEVELS), level).otherwise("info") == x).alias(x) for x in LEVELS))
    return n.unpivot([], LEVELS, "level", "count")


_CATEGORY = "CASE WHEN len(string_split(check_id, '.')) >= 3 THEN string_split(check_id, '.')[3] ELSE check_id END"


@query("owasp_category_counts", sql("findings", f"SELECT {_CATEGORY} AS category, count(*) AS count FROM findings GROUP BY 1"))
def owasp_category_counts(t: Tables) -> DataFrame:
    parts = F.split("check_id", "[.]")
    return t.findings().groupBy(F.when(F.size(parts) >= 3, F.get(parts, F.lit(2))).otherwise(F.col("check_id")).alias("category")).agg(F.count(F.lit(1)).alias("count"))


def _artifact(kind: str) -> F.Column:
    """An artifact of an event as JSON: a list for even users, else an object with a list."""
    each = F.concat(F.lit('["'), "event_id", F.lit('"]'))
    return F.when(F.col("user_id") % 2 == 0, each).otherwise(F.concat(F.lit(f'{{"{kind}": '), each, F.lit(', "n": 1}')))


_G = "WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)"


@query("type_error_count", _G + " SELECT user_id, n AS type_errors FROM g")
def type_error_count(t: Tables) -> DataFrame:
    v = t.events.select("user_id", F.try_parse_json(_artifact("generalDiagnostics")).alias("v"))
    return v.groupBy("user_id").agg(F.sum(A.type_errors(F.col("v"))).alias("type_errors"))


@query("dead_code_count", _G + " SELECT user_id, 2 * n AS dead_code FROM g")
def dead_code_count(t: Tables) -> DataFrame:
    """A list's length and the sum of all lists of an object, in one artifact each."""
    v = t.events.select("user_id", F.try_parse_json(F.concat(F.lit("["), "event_id", F.lit("]"))).alias("vulture"), F.try_parse_json(_artifact("unused")).alias("knip"))
    return v.groupBy("user_id").agg(F.sum(A.length(F.col("vulture")) + A.dead_code(F.col("knip"))).alias("dead_code"))


_COUNTS = """, j AS (SELECT user_id, kind, CASE WHEN json_valid(text) THEN text::JSON END AS j FROM artifacts),
n AS (SELECT user_id, CASE WHEN kind = 'typecheck' THEN CASE json_type(j) WHEN 'ARRAY' THEN json_array_length(j) WHEN 'OBJECT' THEN CASE WHEN json_type(j, '$.generalDiagnostics') = 'ARRAY' THEN json_array_length(j, '$.generalDiagnostics') END END END AS type_errors,
  CASE WHEN kind = 'dead_code' THEN CASE json_type(j) WHEN 'ARRAY' THEN json_array_length(j) WHEN 'OBJECT' THEN (SELECT sum(json_array_length(value)) FROM json_each(j) WHERE type = 'ARRAY') END END AS dead_code FROM j),
f AS (SELECT user_id, lower(coalesce(json_extract_string(e, '$.extra.severity'), 'info')) AS level FROM (SELECT user_id, unnest(json_extract(j, '$.results[*]')) AS e FROM j WHERE kind = 'semgrep' AND json_type(j, '$.results') = 'ARRAY')),
c AS (SELECT user_id, json_extract(e, '$.complexity')::DOUBLE AS c FROM (SELECT user_id, unnest(json_extract(value, '$[*]')) AS e FROM j, json_each(j) WHERE kind = 'complexity' AND json_type(j) = 'OBJECT' AND type = 'ARRAY') WHERE json_type(e, '$.complexity') IS NOT NULL)"""


@query("artifact_counts", sql("artifacts", _COUNTS + """ SELECT user_id, type_errors, dead_code, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(info, 0) AS info, coalesce(functions, 0) AS functions, coalesce(complexity, 0) AS complexity
FROM (SELECT user_id, coalesce(sum(type_errors), 0)::BIGINT AS type_errors, coalesce(sum(dead_code), 0)::BIGINT AS dead_code FROM n GROUP BY 1)
LEFT JOIN (SELECT user_id, count(*) FILTER (level = 'critical') AS critical, count(*) FILTER (level = 'high') AS high, count(*) FILTER (level NOT IN ('critical', 'high', 'medium', 'low')) AS info FROM f GROUP BY 1) USING (user_id)
LEFT JOIN (SELECT user_id, count(*) AS functions, round_even(avg(c), 2) AS complexity FROM c GROUP BY 1) USING (user_id)"""))
def artifact_counts(t: Tables) -> DataFrame:
    """What scanners' artifacts of several shapes come to for each user."""
    a = t.artifacts().select("user_id", "kind", F.try_parse_json("text").alias("v"))
    of = lambda kind, n: F.sum(F.when(F.col("kind") == kind, n).otherwise(F.lit(0)))
    base = a.groupBy("user_id").agg(of("typecheck", A.type_errors(F.col("v"))).alias("type_errors"), of("dead_code", A.dead_code(F.col("v"))).alias("dead_code"))
    found = A.findings(a.where("kind = 'semgrep'")).groupBy("user_id").agg(*(F.count_if(F.col("level") == x).alias(x) for x in ("critical", "high", "info")))
    measured = A.functions(a.where("kind = 'complexity'")).groupBy("user_id").agg(F.count(F.lit(1)).alias("functions"), F.bround(F.avg("complexity"), 2).alias("complexity"))
    return base.join(found, "user_id", "left").join(measured, "user_id", "left").na.fill(0)


_HEALTH = _COUNTS + """, l AS (SELECT sum(CASE WHEN json_type(j) = 'ARRAY' THEN json_array_length(j) ELSE 0 END)::BIGINT AS lint FROM j WHERE kind = 'lint'),
lv AS (SELECT l AS level, (SELECT count(*) FROM f WHERE level = l OR (l = 'info' AND level NOT IN ('critical', 'high', 'medium', 'low'))) AS n FROM (SELECT unnest(['critical', 'high', 'medium', 'low', 'info']) AS l)),
ow AS (SELECT CASE WHEN len(string_split(check_id, '.')) >= 3 THEN string_split(check_id, '.')[3] ELSE check_id END AS category, count(*) AS n FROM findings GROUP BY 1),
health AS (SELECT {'semgrep_findings': (SELECT map_from_entries(list((level, n) ORDER BY level)) FROM lv), 'owasp_findings': (SELECT map_from_entries(list((category, n) ORDER BY category)) FROM ow), 'type_errors': (SELECT sum(type_errors)::BIGINT FROM n), 'lint_violations': lint,
  'dead_code_symbols': (SELECT sum(dead_code)::BIGINT FROM n), 'avg_cyclomatic_complexity': (SELECT round_even(avg(c), 2) FROM c)} AS health FROM l)"""


def health(t: Tables) -> DataFrame:
    """One row with the health section as a struct: maps of findings by level and by category, and numbers, all from the
    scanners' artifacts."""
    a = t.artifacts().select("kind", F.try_parse_json("text").alias("v"))
    of = lambda kind, n: F.sum(F.when(F.col("kind") == kind, n).otherwise(F.lit(0)))
    v = F.col("v")
    counts = a.agg(of("typecheck", A.type_errors(v)).alias("type_errors"), of("lint", A.length(v)).alias("lint_violations"), of("dead_code", A.dead_code(v)).alias("dead_code_symbols"))
    levels = A.findings(a.where("kind = 'semgrep'")).agg(*(F.count_if(F.col("level") == x).alias(x) for x in sorted(LEVELS)))
    levels = levels.select(F.create_map(*(x for level in sorted(LEVELS) for x in (F.lit(level), F.col(level)))).alias("semgrep_findings"))
    owasp = owasp_category_counts(t).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "count")))).alias("owasp_findings"))  # one a category
    mean = A.functions(a.where("kind = 'complexity'")).agg(F.coalesce(F.bround(F.avg("complexity"), 2), F.lit(0.0)).alias("avg_cyclomatic_complexity"))
    one = with_total(with_total(with_total(counts, levels), owasp), mean)
    return one.select(F.struct("semgrep_findings", "owasp_findings", "type_errors", "lint_violations", "dead_code_symbols", "avg_cyclomatic_complexity").alias("health"))


@query("health_record", sql("artifacts findings", _HEALTH + " SELECT to_json(health)::VARCHAR AS record FROM health"))
def health_record(t: Tables) -> DataFrame:
    return health(t).select(F.to_json("health").alias("record"))


@query("avg_complexity", "SELECT event_type, round_even(avg(CAST(json_extract_string(props, '$.k') AS INT)), 2) AS complexity FROM events GROUP BY 1")
def avg_complexity(t: Tables) -> DataFrame:
    k = F.try_to_number(F.get_json_object("props", "$.k"), F.lit("99999"))
    return t.events.groupBy("event_type").agg(F.coalesce(F.bround(F.avg(k.cast("int")), 2), F.lit(0.0)).alias("complexity"))


@query("top_complex_functions", "SELECT concat('f', event_id) AS name, user_id AS file, CAST(json_extract_string(props, '$.k') AS BIGINT) AS complexity, concat(event_id % 900 + 1, '-', event_id % 900 + 1 + event_id % 7) AS lines FROM events ORDER BY complexity DESC, event_id LIMIT 10")
def top_complex_functions(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    line = F.col("event_id") % 900 + 1
    e = t.events.select("event_id", F.concat(F.lit("f"), "event_id").alias("name"), F.col("user_id").alias("file"), k.alias("complexity"), F.concat(line, F.lit("-"), line + F.col("event_id") % 7).alias("lines"))
    return e.orderBy(F.desc("complexity"), "event_id").limit(10).drop("event_id")


@query("parse_finding_lines", """SELECT regexp_extract(l, '^(.+?):(\\d+): (.+)$', 1) AS file, CAST(regexp_extract(l, '^(.+?):(\\d+): (.+)$', 2) AS BIGINT) AS line, regexp_extract(l, '^(.+?):(\\d+): (.+)$', 3) AS message
FROM (SELECT CASE WHEN event_id % 5 = 0 THEN concat('note ', event_type) ELSE concat('src/u', user_id, '.py:', event_id, ': unused ', event_type) END AS l FROM events) WHERE regexp_matches(l, '^(.+?):(\\d+): (.+)$')""")
def parse_finding_lines(t: Tables) -> DataFrame:
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("note "), "event_type")).otherwise(F.concat(F.lit("src/u"), "user_id", F.lit(".py:"), "event_id", F.lit(": unused "), "event_type"))
    form = r"^(.+?):(\d+): (.+)$"
    raw = t.events.select(line.alias("l")).where(F.col("l").rlike(form))
    return raw.select(F.regexp_extract("l", form, 1).alias("file"), F.regexp_extract("l", form, 2).cast("long").alias("line"), F.regexp_extract("l", form, 3).alias("message"))


@query("markdown_table_parse", sql("symbols", "SELECT community AS name, count(*) AS symbols, round_even(count(*) / 7.0::DOUBLE, 3) AS cohesion FROM symbols GROUP BY 1"))
def markdown_table_parse(t: Tables) -> DataFrame:
    """Rows of a markdown table in one text a region, header and separator left out, unreadable rows skipped."""
    per = t.symbols().groupBy("process", "community").agg(F.count(F.lit(1)).alias("n"))
    row = F.concat(F.lit("| "), "community", F.lit(" | "), "n", F.lit(" | "), F.col("n") / 7.0, F.lit(" |"))
    text = per.groupBy("process").agg(F.concat(F.lit("| c.label | c.n | c.h |\n| --- | --- | --- |\n"), F.array_join(F.sort_array(F.collect_list(row)), "\n"), F.lit("\n| odd | x | y |")).alias("md"))
    line = text.select(F.explode(F.split("md", "\n")).alias("l")).where("NOT l LIKE '| ---%' AND NOT l LIKE '| c.%'")
    cells = F.filter(F.transform(F.split("l", "[|]"), lambda x: F.trim(x)), lambda x: x != "")
    c = line.select(cells.alias("c")).select(F.get("c", F.lit(0)).alias("name"), F.get("c", F.lit(1)).try_cast("long").alias("symbols"), F.get("c", F.lit(2)).try_cast("double").alias("cohesion"))
    return c.where("symbols IS NOT NULL AND cohesion IS NOT NULL").withColumn("cohesion", F.bround("cohesion", 3))


@query("json_artifact_parse", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 7 = 0 AS corrupt FROM events")
def json_artifact_parse(t: Tables) -> DataFrame:
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("not "), "props")).otherwise(F.col("props"))
    v = t.events.select("event_id", F.try_parse_json(text).alias("v"))
    return v.select("event_id", F.try_variant_get("v", "$.k", "long").alias("k"), F.col("v").isNull().alias("corrupt"))


@query("json_stats_projection", "SELECT user_id, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS nodes, max(CASE WHEN event_id % 2 = 0 THEN event_id % 97 ELSE 0 END) AS edges FROM events GROUP BY 1")
def json_stats_projection(t: Tables) -> DataFrame:
    meta = t.events.select("user_id", F.concat(F.lit('{"stats": {"nodes": '), F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(', "edges": '), F.col("event_id") % 97)).otherwise(""), F.lit("}}")).alias("meta"))
    get = lambda k: F.coalesce(F.get_json_object("meta", f"$.stats.{k}").cast("long"), F.lit(0))
    return meta.groupBy("user_id").agg(F.max(get("nodes")).alias("nodes"), F.max(get("edges")).alias("edges"))


@query("json_props_extract", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, 'none' AS missing FROM events")
def json_props_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"), F.coalesce(F.get_json_object("props", "$.a.b"), F.lit("none")).alias("missing"))


# fixed values: severities by score, and of another scanner's words
def cvss(score: F.Column) -> F.Column:
    """A severity for the number before the first slash."""
    x = F.substring_index(score, "/", 1).try_cast("double")
    return F.when(x.isNull(), "UNKNOWN").when(x >= 9, "CRITICAL").when(x >= 7, "HIGH").when(x >= 4, "MEDIUM").otherwise("LOW")


_CVSS = "CASE WHEN x IS NULL THEN 'UNKNOWN' WHEN x >= 9 THEN 'CRITICAL' WHEN x >= 7 THEN 'HIGH' WHEN x >= 4 THEN 'MEDIUM' ELSE 'LOW' END"



@query("cvss_severity", f"SELECT s AS score, count(*) AS n, min({_CVSS}) AS severity FROM (SELECT s, TRY_CAST(string_split(s, '/')[1] AS DOUBLE) AS x FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'CVSS:3.1/AV:N' WHEN 1 THEN concat(event_id % 11, '/x') ELSE (event_id % 10)::VARCHAR END AS s FROM events)) GROUP BY 1")
def cvss_severity(t: Tables) -> DataFrame:
    s = F.when(F.col("event_id") % 4 == 0, "CVSS:3.1/AV:N").when(F.col("event_id") % 4 == 1, F.concat(F.col("event_id") % 11, F.lit("/x"))).otherwise((F.col("event_id") % 10).cast("string"))
    return t.events.select(s.alias("score")).groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.min(cvss(F.col("score"))).alias("severity"))


_SEMGREP = "CASE severity WHEN 'ERROR' THEN 'HIGH' WHEN 'WARNING' THEN 'MEDIUM' WHEN 'INFO' THEN 'LOW' ELSE 'UNKNOWN' END"


def semgrep(severity: F.Column) -> F.Column:
    return F.when(severity == "ERROR", "HIGH").when(severity == "WARNING", "MEDIUM").when(severity == "INFO", "LOW").otherwise("UNKNOWN")


@query("semgrep_severity_map", sql("findings", f"SELECT {_SEMGREP} AS mapped, count(*) AS n FROM findings GROUP BY 1"))
def semgrep_severity_map(t: Tables) -> DataFrame:
    return t.findings().groupBy(semgrep(F.col("severity")).alias("mapped")).agg(F.count(F.lit(1)).alias("n"))


@query("restricted_license", "SELECT doc_id, regexp_matches(upper(text), 'GPL|AGPL|LGPL|SSPL|EUPL|CPAL|OSL') AS restricted FROM documents")
def restricted_license(t: Tables) -> DataFrame:
    # fixed values: names of restricted licences
    names = ["GPL", "AGPL", "LGPL", "SSPL", "EUPL", "CPAL", "OSL"]
    return t.documents.select("doc_id", F.coalesce(F.upper("text").rlike("|".join(names)), F.lit(False)).alias("restricted"))


def _union(t: Tables) -> DataFrame:
    """Findings of several tools with columns of their own."""
    f = t.findings()
    a = f.where("check_id LIKE 'owasp%'").select(F.lit("semgrep").alias("tool"), semgrep(F.col("severity")).alias("severity"), "check_id")
    b = t.orders.where("o_orderpriority LIKE '1%'").select(F.lit("osv").alias("tool"), cvss((F.col("o_orderkey") % 11).cast("string")).alias("severity"), F.col("o_orderkey").cast("string").alias("package"))
    c = t.supplier.select(F.lit("licenses").alias("tool"), F.lit("MEDIUM").alias("severity"), F.col("s_name").alias("package"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


_UNION = f""", u AS (SELECT 'semgrep' AS tool, {_SEMGREP} AS severity, check_id, NULL AS package FROM findings WHERE check_id LIKE 'owasp%'
UNION ALL SELECT 'osv', {_CVSS}, NULL, o_orderkey::VARCHAR FROM (SELECT o_orderkey, (o_orderkey % 11)::DOUBLE AS x FROM orders WHERE o_orderpriority LIKE '1%')
UNION ALL SELECT 'licenses', 'MEDIUM', NULL, s_name FROM supplier)"""


@query("findings_union", sql("findings", _UNION + " SELECT * FROM u"))
def findings_union(t: Tables) -> DataFrame:
    return _union(t)


@query("security_report_summary", sql("findings", _UNION + " SELECT severity, tool, count(*) AS n FROM u GROUP BY GROUPING SETS ((severity), (tool))"))
def security_report_summary(t: Tables) -> DataFrame:
    u = _union(t)
    return u.groupingSets([[F.col("severity")], [F.col("tool")]], F.col("severity"), F.col("tool")).agg(F.count(F.lit(1)).alias("n"))


@query("error_rate_by_type", "SELECT user_id % 10 AS bucket, round_even(100.0::DOUBLE * count(*) FILTER (event_type = 'error') / count(*), 1) AS percentage FROM events GROUP BY 1")
def error_rate_by_type(t: Tables) -> DataFrame:
    return t.events.groupBy((F.col("user_id") % 10).alias("bucket")).agg(percent(F.count_if(F.col("event_type") == "error"), F.count(F.lit(1))).alias("percentage"))
