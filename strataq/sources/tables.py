"""Readers of the given tables and the logical tables made from them.

Each logical table is a DataFrame here and, for the oracles, a common table expression of the same name in ``CTES``.
"""

from __future__ import annotations

from copy import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ["py", "ts", "tsx", "js", "go", "rs", "java", "md"]


#: Dependencies of the manifests, with names that hold others' names.
PACKAGES = ["django", "djangorestframework", "flask", "Flask_Cors", "fastapi", "react", "react-dom", "preact", "next", "nextra", "express", "expression", "pytest", "pytest-cov", "pydantic", "pydantic_settings", "sqlalchemy", "langchain", "strands-agents", "rails", "aws-cdk-lib", "spring-boot"]

#: Tables whose rows grow with the input and that others are joined with by key.
GROWING = ["customer", "supplier", "part", "orders", "lineitem", "events", "labels"]

#: The base date of the diffs.
SINCE = "1998-01-01"


def tool_calls(events: DataFrame) -> DataFrame:
    """(session, seq, ts, tool, status, value, result): a tool call for each event, of a table or a stream."""
    names = ["read_heuristic_summary", "dispatch_team", "rg_search", "gitnexus_query", "read_team_findings", "write_bundle", "shell", "context7_query-docs", "git_hotspots"]
    tool = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    failed = F.col("event_type") == "error"
    result = F.when(failed, F.concat(F.lit('{"status": "error", "message": "m'), F.col("event_id"), F.lit('"}'))).otherwise(F.concat(F.lit('{"status": "success", "file_count": '), F.col("user_id"), F.lit("}")))
    return events.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), "ts", tool.alias("tool"), F.when(failed, "error").otherwise("completed").alias("status"), "value", result.alias("result"))


class Tables:
    """Tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.sorts = spark, sf_dir, False

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return table.hint("merge") if self.sorts and name in GROWING else table

    def holding(self, **written: DataFrame) -> Tables:
        """The same tables, of which those named are what was written of them."""
        t = copy(self)
        for name, df in written.items():
            setattr(t, name, lambda df=df: df)
        return t

    def merging(self) -> Tables:
        """The same tables, of which those that grow are joined by sorting: a Parquet file's size says too little of its
        rows to broadcast it. Joins whose small side is known say so themselves, which goes first."""
        t = copy(self)
        t.sorts = True
        return t

    def literal(self, schema: str, rows: list[tuple]) -> DataFrame:
        """A small dictionary as a table (broadcast by its size)."""
        return self.spark.createDataFrame(rows, schema)

    def commits(self) -> DataFrame:
        """One commit for each order; newest first is (date, hash) descending."""
        c = self.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("author"))
        return self.orders.join(c, "o_custkey").select(F.col("o_orderkey").alias("hash"), "author", F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("message"))

    def paths(self) -> DataFrame:
        """A source file for each part."""
        ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), F.col("p_size") % len(EXTENSIONS) + 1)
        return self.part.select("p_partkey", F.concat("p_brand", F.lit("/"), "p_type", F.lit("/part_"), "p_partkey", F.lit("."), ext).alias("path"))

    def commit_files(self, of: DataFrame | None = None) -> DataFrame:
        """Distinct (hash, path): the files of each commit, or of the few commits ``of`` only."""
        pairs = self.lineitem.select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("p_partkey"))
        if of is not None:
            pairs = pairs.join(F.broadcast(of.select("hash")), "hash", "left_semi")  # a window's rows
        return pairs.distinct().join(self.paths(), "p_partkey").select("hash", "path")

    def files(self) -> DataFrame:
        """(ordinal, path, content) of a text file for each document."""
        return self.documents.select(F.col("doc_id").alias("ordinal"), F.concat_ws("/", "source", "lang", "doc_id").alias("path"), F.col("text").alias("content"))

    def files_and_origin(self) -> DataFrame:
        """``files`` with the table's own file that each is from, its size and time."""
        own = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_size", "size"), ("file_modification_time", "modified"))]
        return self.documents.select(F.col("doc_id").alias("ordinal"), F.concat_ws("/", "source", "lang", "doc_id").alias("path"), F.col("text").alias("content"), *own)

    def findings(self) -> DataFrame:
        """(id, check_id, severity, file) of a scanner finding for each event."""
        kind = F.col("event_type")
        severity = F.when(kind == "error", "critical").when(kind == "purchase", "HIGH").when(kind == "click", "ERROR").when(kind == "view", "medium").otherwise(F.lit(None))
        check = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("owasp.top10."), kind, F.lit(".r"), F.col("user_id") % 7)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("lang.sec."), kind)).otherwise(F.concat(F.lit("misc."), kind))
        return self.events.select(F.col("event_id").alias("id"), check.alias("check_id"), severity.alias("severity"), (F.col("user_id") % 50).alias("file_id"))

    def tool_events(self) -> DataFrame:
        """(session, seq, tool, status, value, result) of a tool call for each event."""
        return tool_calls(self.events)

    def risk_snapshots(self) -> DataFrame:
        """(area, seq, risk_level, churn_rank, contributor_count, test_coverage) of an area for each day; an area has the
        name of a community."""
        name = self.nation.select(F.col("n_nationkey").alias("k"), F.lower("n_name").alias("area"))
        by = self.events.withColumn("k", F.col("user_id") % 12).join(F.broadcast(name), "k").groupBy("area", F.to_date("ts").alias("day"))  # of fixed size
        s = by.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("contributor_count"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"))
        level = F.element_at(F.array(*map(F.lit, ["low", "medium", "high", "critical"])), (F.col("n") % 4 + 1).cast("int"))
        coverage = F.element_at(F.array(*map(F.lit, ["none", "low", "medium", "high"])), (F.col("errors") % 4 + 1).cast("int"))
        return s.select("area", F.date_format("day", "yyyy-MM-dd").alias("seq"), level.alias("risk_level"), F.col("n").alias("churn_rank"), "contributor_count", coverage.alias("test_coverage"))

    def symbols(self) -> DataFrame:
        """(symbol, community, process) of each supplier; nations and regions are of fixed size."""
        n = self.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
        return self.supplier.join(F.broadcast(n), "s_nationkey").join(F.broadcast(self.region), "r_regionkey").select("s_suppkey", F.col("s_name").alias("symbol"), F.col("n_name").alias("community"), F.col("r_name").alias("process"))

    def symbol_parts(self) -> DataFrame:
        """(p_partkey, symbol, community, process): the symbol that a file defines is the first supplier of its part."""
        first = self.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("s_suppkey"))
        return first.join(self.symbols(), "s_suppkey").select("p_partkey", "symbol", "community", "process")

    def symbol_files(self) -> DataFrame:
        """(symbol, community, process, path): where symbols are defined."""
        return self.symbol_parts().join(self.paths(), "p_partkey").select("symbol", "community", "process", "path")

    def change_parts(self, since: str = SINCE) -> DataFrame:
        """(change_id, p_partkey): the change of each customer is what they changed since the base date of the diff."""
        o = self.orders.where(F.to_date("o_orderdate") >= since).select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("change_id"))
        return self.lineitem.select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(o, "l_orderkey").select("change_id", "p_partkey").distinct()

    def change_sets(self, since: str = SINCE) -> DataFrame:
        """(change_id, path): the files of each change."""
        return self.change_parts(since).join(self.paths(), "p_partkey").select("change_id", "path")

    def scans(self) -> DataFrame:
        """(change_id, critical, high, violations): the newest day's scanner findings of the repository that a change is
        of, and what its pattern file counts as violations. Partial aggregates keep a hot repository small."""
        kind = F.col("event_type")
        k = F.when((kind == "view") & (F.col("event_id") % 3 == 0), F.coalesce(F.get_json_object("props", "$.k").cast("long") % 5, F.lit(0))).otherwise(0)
        day = self.events.groupBy(F.col("user_id").alias("change_id"), F.to_date("ts").alias("day")).agg(F.count_if(kind == "error").alias("critical"), F.count_if(kind == "purchase").alias("high"), F.sum(k).alias("violations"))
        return day.groupBy("change_id").agg(F.max(F.struct("day", "critical", "high", "violations")).alias("s")).select("change_id", "s.critical", "s.high", "s.violations")

    def areas(self) -> DataFrame:
        """(area, recommendation) of a risk profile: an area for each brand and kind of part; some recommend nothing, or
        what is no tier."""
        per = self.part.groupBy(F.lower(F.concat("p_brand", F.lit("/"), F.split("p_type", " ")[0])).alias("area")).agg(F.count(F.lit(1)).alias("n"))
        m = F.col("n") % 7
        return per.select("area", F.when(m == 0, "expert_review").when(m == 1, "dual_review").when(m == 2, F.lit(None)).when(m == 3, "unheard_of").otherwise("auto_merge").alias("recommendation"))

    def index_ages(self) -> DataFrame:
        """(change_id, age_hours) of the index that a change is held against: an hour for each day from its newest commit
        to the newest of all."""
        o = self.orders.groupBy(F.col("o_custkey").alias("change_id")).agg(F.max(F.to_date("o_orderdate")).alias("day"))
        last = self.orders.agg(F.max(F.to_date("o_orderdate")).alias("last"))
        return o.crossJoin(F.broadcast(last)).select("change_id", F.datediff("last", "day").cast("double").alias("age_hours"))  # one row

    def artifacts(self) -> DataFrame:
        """(user_id, kind, text): what a scanner left of each event, in the shapes that they use, some of them broken."""
        k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_id") % 4
        diagnostics = F.when(k % 5 == 0, F.concat(F.lit("["), F.repeat(F.lit('{"m": 1}, '), k % 3), F.lit('{"m": 2}]'))).when(k % 5 == 1, F.concat(F.lit('{"generalDiagnostics": [1, 2], "n": '), k, F.lit("}"))).when(k % 5 == 2, '{"generalDiagnostics": "none"}').when(k % 5 == 3, F.concat(F.lit("error: "), k)).otherwise('"text"')
        unused = F.when(k % 4 == 0, '["a", "b"]').when(k % 4 == 1, '{"files": ["x"], "exports": [1, 2, 3], "n": 4}').when(k % 4 == 2, '{"files": {}}').otherwise("")
        results = F.when(k % 4 == 0, '{"results": [{"extra": {"severity": "ERROR"}, "check_id": "a"}, {"extra": {"severity": "High"}}]}').when(k % 4 == 1, '{"results": [{"extra": {}}, {}, {"extra": {"severity": "critical"}}]}').when(k % 4 == 2, '{"results": {"x": 1}}').otherwise("[1]")
        measured = F.when(k % 3 < 2, F.concat(F.lit('{"f'), "user_id", F.lit('.py": [{"name": "g'), "event_id", F.lit('", "complexity": '), k, F.lit('}, {"name": "h"}, 7], "odd": 3}'))).otherwise("[3]")
        names = F.element_at(F.array(*map(F.lit, ["typecheck", "dead_code", "semgrep", "complexity", "lint", "dead_code", "semgrep", "complexity"])), (F.col("event_id") % 8 + 1).cast("int"))
        return self.events.select("user_id", names.alias("kind"), F.when(kind == 0, diagnostics).when(kind == 1, unused).when(kind == 2, results).otherwise(measured).alias("text"))

    def manifests(self) -> DataFrame:
        """(repo, file, line): a line of a dependency manifest for each part, names that look alike among them."""
        n = len(PACKAGES)
        name = F.element_at(F.array(*map(F.lit, PACKAGES)), (F.col("p_partkey") * 7 % n + 1).cast("int"))
        k, v = F.col("p_partkey") % 9, F.concat(F.col("p_size") % 5, F.lit("."), F.col("p_partkey") % 7)
        text = F.when(k == 0, F.concat(name, F.lit("[extra]>="), v, F.lit(' ; python_version > "3.8"  # why'))).when(k == 1, F.concat(F.upper(name), F.lit("=="), v)).when(k == 2, F.concat(F.lit("-r base.txt # "), name))
        toml = F.when(k == 3, F.concat(name, F.lit(' = "^'), v, F.lit('"'))).when(k == 4, F.concat(F.lit('    "'), name, F.lit(">="), v, F.lit('",'))).when(k == 5, F.concat(F.lit("# "), name, F.lit(' = "1"')))
        package = F.when(k == 6, F.concat(F.lit('    "'), name, F.lit('": "^'), v, F.lit('",'))).when(k == 7, F.concat(F.lit('  "'), name, F.lit('": {'))).otherwise(F.concat(F.lit('    "@x/'), name, F.lit('": "'), v, F.lit('"')))
        file = F.when(k < 3, "requirements.txt").when(k < 6, "pyproject.toml").otherwise("package.json")
        return self.part.select((F.floor(F.col("p_partkey") / 9) % 50).alias("repo"), file.alias("file"), F.coalesce(text, toml, package).alias("line"))

    def tree(self) -> DataFrame:
        """(p_partkey, path): files of a working tree, some of them in folders or of kinds that searches leave out."""
        k = F.col("p_partkey")
        top = F.when(k % 11 == 0, "web/node_modules/").when(k % 13 == 0, "dist/").when(k % 17 == 0, "distant/").otherwise("")
        return self.paths().select("p_partkey", F.concat(top, F.when(k % 19 == 0, F.concat(F.lit("img/p"), k, F.lit(".PNG"))).otherwise(F.col("path"))).alias("path"))

    def messages(self) -> DataFrame:
        return self.conversations

    def bundles(self) -> DataFrame:
        """(area, content) of a markdown text for each part."""
        p = self.part
        line = F.concat(F.lit("See src/"), "p_brand", F.lit("/mod_"), F.col("p_partkey") % 13, F.lit(".py and app.py:"), "p_partkey")
        head = F.concat(F.lit("## "), "p_name", F.lit("\n"))
        body = F.repeat(F.concat(line, F.lit("\n")), F.col("p_size"))
        figure = F.when(F.col("p_partkey") % 3 == 0, "```mermaid\ngraph\n```\n").when(F.col("p_partkey") % 3 == 1, "").otherwise("```Mermaid\n```\n```mermaid\n```\n")
        return p.select(F.concat(F.lit("a"), "p_partkey").alias("area"), F.concat(F.repeat(head, F.col("p_size") % 12), body, figure).alias("content"))


_PACKAGES = "[" + ", ".join(f"'{x}'" for x in PACKAGES) + "]"
_K = "CAST(json_extract_string(props, '$.k') AS INT)"
CTES = {
    "artifacts": f"""SELECT user_id, (['typecheck', 'dead_code', 'semgrep', 'complexity', 'lint', 'dead_code', 'semgrep', 'complexity'])[event_id % 8 + 1] AS kind, CASE event_id % 4
WHEN 0 THEN CASE k % 5 WHEN 0 THEN concat('[', repeat('{{"m": 1}}, ', k % 3), '{{"m": 2}}]') WHEN 1 THEN concat('{{"generalDiagnostics": [1, 2], "n": ', k, '}}') WHEN 2 THEN '{{"generalDiagnostics": "none"}}' WHEN 3 THEN concat('error: ', k) ELSE '"text"' END
WHEN 1 THEN CASE k % 4 WHEN 0 THEN '["a", "b"]' WHEN 1 THEN '{{"files": ["x"], "exports": [1, 2, 3], "n": 4}}' WHEN 2 THEN '{{"files": {{}}}}' ELSE '' END
WHEN 2 THEN CASE k % 4 WHEN 0 THEN '{{"results": [{{"extra": {{"severity": "ERROR"}}, "check_id": "a"}}, {{"extra": {{"severity": "High"}}}}]}}' WHEN 1 THEN '{{"results": [{{"extra": {{}}}}, {{}}, {{"extra": {{"severity": "critical"}}}}]}}' WHEN 2 THEN '{{"results": {{"x": 1}}}}' ELSE '[1]' END
ELSE CASE WHEN k % 3 < 2 THEN concat('{{"f', user_id, '.py": [{{"name": "g', event_id, '", "complexity": ', k, '}}, {{"name": "h"}}, 7], "odd": 3}}') ELSE '[3]' END END AS text FROM (SELECT *, {_K} AS k FROM events)""",
    "manifests": f"""SELECT p_partkey // 9 % 50 AS repo, CASE WHEN k < 3 THEN 'requirements.txt' WHEN k < 6 THEN 'pyproject.toml' ELSE 'package.json' END AS file, name, v, k
FROM (SELECT p_partkey, p_partkey % 9 AS k, {_PACKAGES}[p_partkey * 7 % {len(PACKAGES)} + 1] AS name, concat(p_size % 5, '.', p_partkey % 7) AS v FROM part)""",
    "tree": "SELECT p_partkey, concat(CASE WHEN p_partkey % 11 = 0 THEN 'web/node_modules/' WHEN p_partkey % 13 = 0 THEN 'dist/' WHEN p_partkey % 17 = 0 THEN 'distant/' ELSE '' END, CASE WHEN p_partkey % 19 = 0 THEN concat('img/p', p_partkey, '.PNG') ELSE path END) AS path FROM paths",
    "commits": "SELECT o_orderkey AS hash, c_name AS author, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS message FROM orders JOIN customer ON c_custkey = o_custkey",
    "paths": "SELECT p_partkey, concat(p_brand, '/', p_type, '/part_', p_partkey, '.', CASE p_size % 8 WHEN 0 THEN 'py' WHEN 1 THEN 'ts' WHEN 2 THEN 'tsx' WHEN 3 THEN 'js' WHEN 4 THEN 'go' WHEN 5 THEN 'rs' WHEN 6 THEN 'java' ELSE 'md' END) AS path FROM part",
    "commit_files": "SELECT DISTINCT l_orderkey AS hash, path FROM lineitem JOIN paths ON p_partkey = l_partkey",
    "files": "SELECT doc_id AS ordinal, concat(source, '/', lang, '/', doc_id) AS path, text AS content FROM documents",
    "findings": "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN concat('owasp.top10.', event_type, '.r', user_id % 7) WHEN 1 THEN concat('lang.sec.', event_type) ELSE concat('misc.', event_type) END AS check_id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'HIGH' WHEN 'click' THEN 'ERROR' WHEN 'view' THEN 'medium' END AS severity, user_id % 50 AS file_id FROM events",
    "tool_events": "SELECT user_id AS session, event_id AS seq, ts, (['read_heuristic_summary', 'dispatch_team', 'rg_search', 'gitnexus_query', 'read_team_findings', 'write_bundle', 'shell', 'context7_query-docs', 'git_hotspots'])[event_id % 9 + 1] AS tool, CASE WHEN event_type = 'error' THEN 'error' ELSE 'completed' END AS status, value, CASE WHEN event_type = 'error' THEN concat('{\"status\": \"error\", \"message\": \"m', event_id, '\"}') ELSE concat('{\"status\": \"success\", \"file_count\": ', user_id, '}') END AS result FROM events",
    "risk_snapshots": "SELECT area, seq, (['low', 'medium', 'high', 'critical'])[n % 4 + 1] AS risk_level, n AS churn_rank, contributor_count, (['none', 'low', 'medium', 'high'])[errors % 4 + 1] AS test_coverage FROM (SELECT lower(n_name) AS area, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS seq, count(*) AS n, count(DISTINCT user_id) AS contributor_count, count(*) FILTER (event_type = 'error') AS errors FROM events JOIN nation ON n_nationkey = user_id % 12 GROUP BY 1, 2)",
    "symbols": "SELECT s_suppkey, s_name AS symbol, n_name AS community, r_name AS process FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey",
    "symbol_files": "SELECT symbol, community, process, path FROM (SELECT l_partkey, min(l_suppkey) AS k FROM lineitem GROUP BY 1) JOIN symbols ON s_suppkey = k JOIN paths ON p_partkey = l_partkey",
    "change_sets": "SELECT DISTINCT o_custkey AS change_id, path FROM commit_files JOIN orders ON o_orderkey = hash WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01'",
    "scans": "SELECT change_id, critical, high, violations FROM (SELECT user_id AS change_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') AS critical, count(*) FILTER (event_type = 'purchase') AS high, sum(CASE WHEN event_type = 'view' AND event_id % 3 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 ELSE 0 END)::BIGINT AS violations FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY day DESC) = 1",
    "areas": "SELECT area, CASE n % 7 WHEN 0 THEN 'expert_review' WHEN 1 THEN 'dual_review' WHEN 2 THEN NULL WHEN 3 THEN 'unheard_of' ELSE 'auto_merge' END AS recommendation FROM (SELECT lower(concat(p_brand, '/', string_split(p_type, ' ')[1])) AS area, count(*) AS n FROM part GROUP BY 1)",
    "index_ages": "SELECT o_custkey AS change_id, date_diff('day', max(CAST(o_orderdate AS DATE)), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders))::DOUBLE AS age_hours FROM orders GROUP BY 1",
    "bundles": "SELECT concat('a', p_partkey) AS area, concat(repeat(concat('## ', p_name, chr(10)), p_size % 12), repeat(concat('See src/', p_brand, '/mod_', p_partkey % 13, '.py and app.py:', p_partkey, chr(10)), p_size), CASE p_partkey % 3 WHEN 0 THEN concat('```mermaid', chr(10), 'graph', chr(10), '```', chr(10)) WHEN 1 THEN '' ELSE concat('```Mermaid', chr(10), '```', chr(10), '```mermaid', chr(10), '```', chr(10)) END) AS content FROM part",
}
_NEEDS = {"tree": ["paths"], "commit_files": ["paths"], "symbol_files": ["symbols", "paths"], "change_sets": ["paths", "commit_files"]}


def sql(names: str, body: str) -> str:
    """``body`` after the logical tables that it names; ``body`` may go on with ", name AS (...)" before its SELECT."""
    order: list[str] = []
    for n in names.split():
        for k in [*_NEEDS.get(n, []), n]:
            if k not in order:
                order.append(k)
    body = body.strip()
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + ("" if body.startswith(",") else "\n") + body
