"""Fixtures with expected values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from strataq.functions import shell, text
from strataq.operators import retrieval, risk


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("given, want", [("getUserName", ["get", "user", "name"]), ("get_user_name", ["get", "user", "name"]), ("a b cc dd", ["cc", "dd"]), ("", [])])
def test_tokens(spark, given, want):
    assert spark.range(1).select(text.tokens(F.lit(given)).alias("t")).first()["t"] == want


def test_matching_lines_and_search(spark):
    f = spark.createDataFrame([(0, "x", "line one\ndef authenticate():\n  pass\n")], "ordinal long, path string, content string")
    assert rows(retrieval.matching_lines(f, "authenticate").select("line_number")) == [(2,)]
    many = spark.createDataFrame([(0, "x", "\n".join(f"auth line{i}" for i in range(4)))], "ordinal long, path string, content string")
    assert retrieval.matching_lines(many, "auth", most=2).count() == 2
    assert rows(retrieval.count_lines(many, "auth")) == [("x", 4)]
    assert rows(retrieval.read_bounded(many, most=1, start=2).select("body", "truncated")) == [("     2| auth line1", True)]


@pytest.mark.parametrize("block, esc, warn, area, fresh, want", [
    (1, 0, 0, None, "current", "block"), (0, 0, 0, None, "current", "auto_merge"), (0, 0, 1, None, "current", "single_review"), (0, 0, 2, None, "current", "single_review"),
    (0, 0, 3, None, "current", "dual_review"), (0, 1, 1, None, "current", "dual_review"), (0, 2, 1, None, "current", "expert_review"), (0, 4, 0, None, "current", "block"),
    (0, 0, 0, "dual_review", "current", "dual_review"), (0, 0, 0, "auto_approve", "current", "auto_merge"), (0, 0, 0, None, "outdated", "single_review"),
])
def test_tier(spark, block, esc, warn, area, fresh, want):
    t = risk.tier(F.lit(block), F.lit(esc), F.lit(warn), F.lit(area).cast("string"), F.lit(fresh))
    assert spark.range(1).select(t.alias("t")).first()["t"] == want


@pytest.mark.parametrize("levels, want", [
    (["low", "medium"], ("degrading", "high")), (["low", "medium", "high", "critical"], ("accelerating_risk", "critical")), (["high", "medium"], ("improving", "low")),
    (["medium", "medium"], ("stable", "medium")), (["low", "low", "medium"], ("degrading", "high")), (["medium", "bogus"], ("stable", "medium")), (["low"], ("stable", "medium")),
])
def test_trend(spark, levels, want):
    s = spark.createDataFrame([("a", str(i), x, 5 - i, 1, "low") for i, x in enumerate(levels)], "area string, seq string, risk_level string, churn_rank long, contributor_count long, test_coverage string")
    assert rows(risk.trends(s).select("risk_trend", "projected_risk")) == [want]


def test_signals(spark):
    n = spark.createDataFrame([(x,) for x in (0, 1, 5, 6, 20, 21, 50, 51)], "n long")
    assert [r[0] for r in rows(n.select(risk.blast_severity(F.col("n"))))] == [None, "info", "info", "warning", "warning", "escalation", "escalation", "block"]
    c = risk.confidence(F.col("a"), F.col("g"), F.col("n"), F.col("p"))
    d = spark.createDataFrame([(True, True, 3, 0.0), (False, False, 0, 0.0), (False, False, 0, 0.3), (True, False, 0, 0.15)], "a boolean, g boolean, n int, p double")
    assert [round(r[0], 4) for r in rows(d.select(c))] == [0.95, 0.4, 0.1, 0.65]
    h = spark.createDataFrame([(48.0,), (48.001,), (168.0,), (168.001,), (None,)], "h double")
    assert [r[0] for r in rows(h.select(risk.freshness(F.col("h"))[0]))] == ["current", "stale", "stale", "outdated", "current"]


@pytest.mark.parametrize("command, why", [
    ("tree -L 2", None), ("git shortlog -sn", None), ("sort names.txt", None), ("git --git-dir x.git show", None), ("LANG=C git diff", None), ("make && make test", "operator"), ("head a | tail", "operator"),
    ("printf `date`", "operator"), ("printf $(date)", "operator"), ("printf ${USER}", "operator"), ("printf x >> y", "operator"), ("wget x", "program"), ("./run", "operator"), ("git commit", "git"), ("git", None),
    ("git config core.editor vi", "git"), ("git config --list", None), ("git config", None), ("less /proc/cpuinfo", "path"), ("du /boot", "path"), ("du /bootstrap", None), ("   ", "empty"), (None, "empty"), ("X=1 Y=2", "empty"), ('tr "a b', "malformed"),
    ("cat /srv/../etc/hosts", "path"), ("cat //etc//hosts", "path"), ("cat /etc/../srv/x", "path"), ("cat /srv/./x", None), ("cat ../etc/hosts", None), ("/bin/CAT /sys", "path"),
])
def test_commands(command, why):
    assert shell.refusal(command) == why


def test_search_context(spark):
    f = spark.createDataFrame([(0, "x", "a\nb1\nc\nd2\ne"), (1, "y", None)], "ordinal long, path string, content string")
    assert rows(retrieval.search_context(f, "[0-9]", context=1).orderBy("line_number")) == [("x", 2, "b1", "a", "c"), ("x", 4, "d2", "c", "e")]


def test_blame_carries_forward(spark):
    from strataq.plans.sections import blame

    lines = ["\tno author yet", "author-mail <a@x>", "author-time 86400", "\tone", "\ttwo", "author-time soon", "\tthree", "author-mail <b@x>", "author-time 0", "\tfour"]
    got = blame(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, seq long, line string"))
    assert sorted(rows(got.select("email", "lines", "last_commit_date", "percentage"))) == [("a@x", 3, "unknown", 75.0), ("b@x", 1, "1970-01-01", 25.0)]


def test_views_by_name(spark):
    from strataq.plans import sections
    from strataq.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError):
        sections.static_scan(t, "other")
    with pytest.raises(ValueError):
        sections.git_evolution(t, "other")
    some, none = spark.createDataFrame([("p", 1)], "path string, n long"), spark.createDataFrame([], "path string, n long")
    assert rows(sections.or_else(some, some)) == [("p", 1, "own")] and rows(sections.or_else(none, some)) == [("p", 1, "summary")]


def test_verdict_assembly(spark):
    """One change with a signal of each family, one without any."""
    one = lambda schema, *v: spark.createDataFrame([v], schema)
    change = spark.createDataFrame([(1, 2, 21, 21, 2, ["A", "B"], True, "dual_review", 50.0), (2, 1, 0, 0, 0, [], False, None, None)], "change_id long, n_files long, blast_radius long, n_symbols long, communities long, names array<string>, analysed boolean, area_tier string, age_hours double")
    scans = one("change_id long, critical long, high long, violations long", 1, 0, 2, 5)
    trend = one("change_id long, area string, risk_trend string, projected_risk string, current_risk string", 1, "a", "degrading", "high", "medium")
    parts = [risk.blast_signals(change), risk.community_signals(change), risk.security_signals(scans), risk.churn_signals(one("change_id long, n_hot long, hot_paths array<string>", 1, 1, ["p"])), risk.bus_signals(one("change_id long, areas long", 1, 1)), risk.trend_signals(trend, "change_id"), risk.pattern_signals(scans)]
    rows_ = parts[0]
    for p in parts[1:]:
        rows_ = rows_.unionByName(p)
    v = {r.change_id: r for r in risk.assemble(change.join(risk.gathered(rows_), "change_id", "left")).collect()}
    assert [s.signal_type for s in v[1].signals] == ["blast_radius", "cross_community", "security_finding", "churn_rate", "bus_factor", "complexity_spike", "pattern_violation"]
    assert (v[1].verdict, v[1].next_verdict, v[1].confidence, v[1].exit_code, v[1].should_block, v[1].freshness) == ("block", "block", 0.8, 3, True, "stale")
    assert v[1].labels == "blocked,needs-security-review,bus-factor-risk,high-blast-radius" and len(v[1].reasons) == 3
    assert (v[2].verdict, v[2].next_verdict, v[2].confidence, v[2].distance, v[2].labels, v[2].reasons) == ("auto_merge", "single_review", 0.4, 0.0, "auto-approvable", [])
    blocked = risk.security_signals(one("change_id long, critical long, high long, violations long", 3, 1, 9, 0)).first()
    assert (blocked.severity, blocked.weight) == ("block", 1.0)
    assert risk.security_signals(scans, critical_over=0, high_over=2).count() == 0


def test_escape_and_cut(spark):
    r = spark.range(1).select(text.escape_html(F.lit("<a href=\"x\">&'")).alias("e"), text.cut(F.lit("abcdef"), 3, "…").alias("c"), text.suffix(F.lit("src/.env")).alias("n"), text.suffix(F.lit("a/B.PY")).alias("s")).first()
    assert tuple(r) == ("&lt;a href=&quot;x&quot;&gt;&amp;&#x27;", "abc…", "", ".py")


def test_stream_equals_batch(spark, tmp_path):
    from strataq.streaming import events as E

    src = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(src)
    like = spark.read.parquet(src)
    out = str(tmp_path / "out")
    E.follow(src, like, lambda s: E.tumbling(s, late="1 hour"), out, str(tmp_path / "check"))
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    want = {tuple(r) for r in E.tumbling(like).collect()}
    last = max(w[0] for w in want)
    assert got == {w for w in want if w[0] < last}  # the last window stays open
