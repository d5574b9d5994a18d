"""Risk trends over snapshots and the change verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: levels in order, and the tiers of a verdict
RISKS = ["low", "medium", "high", "critical"]
COVERAGE = ["none", "low", "medium", "high"]
TIERS = ["auto_merge", "single_review", "dual_review", "expert_review", "block"]
KEPT_SNAPSHOTS = 10


def ordinal(value: Column, names: list[str]) -> Column:
    """The place of a name from 0; 1 for any other."""
    at = F.array_position(F.array(*map(F.lit, names)), value)
    return F.when(at > 0, at - 1).otherwise(F.lit(1)).cast("int")


def named(at: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), at + 1)


def history(snapshots: DataFrame) -> DataFrame:
    """The newest snapshots of each area with their ordinals, those before, and ``islands`` that number, newest first,
    the runs of rising risk."""
    newest = Window.partitionBy("area").orderBy(F.desc("seq"))
    kept = snapshots.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= KEPT_SNAPSHOTS)
    kept = kept.withColumn("risk", ordinal(F.coalesce("risk_level", F.lit("medium")), RISKS)).withColumn("coverage", ordinal(F.coalesce("test_coverage", F.lit("low")), COVERAGE))
    w = Window.partitionBy("area").orderBy("seq")
    for c in ("risk", "coverage", "churn_rank", "contributor_count"):
        kept = kept.withColumn(f"before_{c}", F.lag(c).over(w))
    rises = F.coalesce(F.col("risk") > F.col("before_risk"), F.lit(False))
    return kept.withColumn("island", F.sum(F.when(rises, 0).otherwise(1)).over(newest.rowsBetween(Window.unboundedPreceding, 0)))


def streaks(h: DataFrame) -> DataFrame:
    return h.groupBy("area").agg(F.count_if(F.col("island") == 0).alias("streak"))


def trends(snapshots: DataFrame) -> DataFrame:
    """One row for each area; an area with one snapshot is stable."""
    h = history(snapshots)
    now = h.where("back = 1").join(streaks(h), "area")
    up, down = F.col("risk") > F.col("before_risk"), F.col("risk") < F.col("before_risk")

    def way(c: str, more: str, less: str) -> Column:
        return F.when(F.col(c) > F.col(f"before_{c}"), more).when(F.col(c) < F.col(f"before_{c}"), less).otherwise("stable")

    ahead = F.least(F.lit(3), F.greatest(F.lit(0), 2 * F.col("risk") - F.col("before_risk")))
    return now.select(
        "area", F.coalesce("risk_level", F.lit("medium")).alias("current_risk"),
        F.when(up & (F.col("streak") >= 3), "accelerating_risk").when(up, "degrading").when(down, "improving").otherwise("stable").alias("risk_trend"),
        F.coalesce((F.col("before_churn_rank") - F.col("churn_rank")).cast("double"), F.lit(0.0)).alias("churn_velocity"),
        way("contributor_count", "gaining", "losing").alias("contributor_trend"),
        way("coverage", "improving", "declining").alias("test_coverage_trend"),
        F.when(F.col("before_risk").isNull(), "medium").otherwise(named(ahead, RISKS)).alias("projected_risk"),
    )


def blast_severity(n: Column) -> Column:
    return F.when(n <= 0, F.lit(None)).when(n > 50, "block").when(n > 20, "escalation").when(n > 5, "warning").otherwise("info")


def community_severity(n: Column) -> Column:
    return F.when(n <= 1, F.lit(None)).when(n <= 3, "warning").otherwise("escalation")


def share(n: Column, whole: int) -> Column:
    return F.least(F.lit(1.0), n / F.lit(float(whole)))


def tier(blocks: Column, escalations: Column, warnings: Column, area: Column, freshness: Column) -> Column:
    """The verdict's tier from counts of signals, an area's recommendation and the age of the data."""
    index = escalations + F.floor((warnings + 1) / 2)
    known = F.array_position(F.array(*map(F.lit, TIERS)), area)
    index = F.greatest(index, F.when(known > 0, known - 1).otherwise(0))
    index = F.when(freshness == "outdated", F.greatest(index, F.lit(1))).otherwise(index)
    return F.when(blocks > 0, "block").otherwise(named(F.least(index, F.lit(4)).cast("int"), TIERS))


def confidence(analysed: Column, graph: Column, signals: Column, penalty: Column) -> Column:
    raw = F.when(analysed, 0.8).otherwise(0.4) + F.when(graph, 0.1).otherwise(0.0) + F.when(signals >= 3, 0.05).otherwise(0.0) - penalty
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), raw))


def boundary(tier_: Column, warnings: Column, escalations: Column, weight: Column) -> Column:
    return F.when(warnings + escalations == 0, 0.0).when((tier_ == "auto_merge") & (warnings > 0), F.least(F.lit(1.0), warnings * 0.3)).otherwise(F.least(F.lit(1.0), weight / 3))


def freshness(hours: Column) -> tuple[Column, Column]:
    """(state, penalty) of data of this age; unknown age counts as current."""
    return F.when(hours > 168, "outdated").when(hours > 48, "stale").otherwise("current"), F.when(hours > 168, 0.3).when(hours > 48, 0.15).otherwise(0.0)


def areas_of(changes: DataFrame, paths: DataFrame, areas: DataFrame) -> DataFrame:
    """(change_id, and the columns of ``areas``) where an area's name is part of a changed path: names meet the distinct
    paths, and these the changes by their key. Areas are brands by kinds, so they are sent to the paths, which grow."""
    low = paths.select("p_partkey", F.lower("path").alias("_path"))
    near = low.join(F.broadcast(areas), F.contains("_path", F.col("area"))).select("p_partkey", *areas.columns)
    return changes.join(near, "p_partkey").select("change_id", *areas.columns)


def area_tiers(matched: DataFrame) -> DataFrame:
    """(change_id, area_tier, areas): the highest recommendation; none counts as a single review, no tier as nothing."""
    at = F.array_position(F.array(*map(F.lit, TIERS)), F.coalesce("recommendation", F.lit("single_review"))) - 1
    per = matched.groupBy("change_id").agg(F.max(at).alias("at"), F.countDistinct("area").alias("areas"))
    return per.select("change_id", F.when(F.col("at") >= 0, named(F.col("at").cast("int"), TIERS)).alias("area_tier"), "areas")


# fixed values: the signals' order, names, sources and sentences
def _rows(df: DataFrame, order: int, kind: str, severity: Column, weight: Column, source: str, description: Column, key: str = "change_id") -> DataFrame:
    return df.select(key, F.lit(order).alias("order"), F.lit(kind).alias("signal_type"), severity.alias("severity"), weight.cast("double").alias("weight"), F.lit(source).alias("source"), description.alias("description"))


def blast_signals(impact: DataFrame) -> DataFrame:
    n = F.col("blast_radius")
    text = F.concat(n, F.lit(" upstream dependents across "), "n_symbols", F.lit(" changed symbols"))
    return _rows(impact.where(n > 0), 1, "blast_radius", blast_severity(n), share(n, 50), "gitnexus_impact", text)


def community_signals(impact: DataFrame) -> DataFrame:
    n = F.size("names")
    text = F.concat(F.lit("Changes span "), n, F.lit(" GitNexus communities: "), F.array_join(F.slice("names", 1, 5), ", "))
    return _rows(impact.where(n > 1), 2, "cross_community", community_severity(n), share(n, 5), "gitnexus_cypher", text)


def security_signals(scans: DataFrame, critical_over: int = 0, high_over: int = 0) -> DataFrame:
    c, h = F.col("critical"), F.col("high")
    worst = c > critical_over
    text = F.when(worst, F.concat(F.lit("Repository has "), c, F.lit(" critical semgrep finding(s) — changed files may be affected"))).otherwise(F.concat(F.lit("Repository has "), h, F.lit(" high-severity semgrep finding(s)")))
    return _rows(scans.where(worst | (h > high_over)), 3, "security_finding", F.when(worst, "block").otherwise("escalation"), F.when(worst, 1.0).otherwise(0.7), "semgrep", text)


def churn_signals(hot: DataFrame) -> DataFrame:
    """Of (change_id, n_hot, hot_paths) with the first three hot files."""
    n = F.col("n_hot")
    text = F.concat(n, F.lit(" changed file(s) are top-10 hotspots: "), F.array_join("hot_paths", ", "))
    return _rows(hot.where(n > 0), 4, "churn_rate", F.lit("warning"), share(n, 5), "git_hotspots", text)


def bus_signals(touched: DataFrame) -> DataFrame:
    """Of (change_id, areas): how many folders with one contributor are touched."""
    text = F.concat(F.lit("Changes touch "), "areas", F.lit(" area(s) with bus factor risk (single contributor)"))
    return _rows(touched.where("areas > 0"), 5, "bus_factor", F.lit("escalation"), F.lit(0.6), "git_contributors", text)


def trend_signals(trends_: DataFrame, key: str = "area") -> DataFrame:
    way = F.col("risk_trend")
    fast = way == "accelerating_risk"
    name = F.concat(F.lit("Area '"), "area", F.lit("' has "))
    text = F.when(fast, F.concat(name, F.lit("accelerating risk trend (projected "), "projected_risk", F.lit(" in 30d)"))).otherwise(F.concat(name, F.lit("degrading risk trend (currently "), "current_risk", F.lit(")")))
    return _rows(trends_.where(fast | (way == "degrading")), 6, "complexity_spike", F.when(fast, "escalation").otherwise("warning"), F.when(fast, 0.7).otherwise(0.4), "temporal_risk", text, key)


def pattern_signals(scans: DataFrame) -> DataFrame:
    n = F.col("violations")
    return _rows(scans.where(n > 0), 7, "pattern_violation", F.lit("warning"), share(n, 10), "patterns.json", F.concat(F.lit("Codebase has "), n, F.lit(" known pattern violation(s)")))


def gathered(signals: DataFrame) -> DataFrame:
    """(change_id, signals): the few signals of each change, in order."""
    fields = ["order", "description", "signal_type", "severity", "weight", "source"]
    return signals.groupBy("change_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("signals"))


# fixed values: sentences of what would raise or lower a tier
def raises(tier_: Column) -> Column:
    first = F.array(F.lit("Any untested code path would trigger single_review"), F.lit("Security finding in changed files would trigger block"))
    later = F.array(F.lit("Additional bus factor risk would escalate"), F.lit("Blast radius > 50 would trigger expert_review"))
    return F.when(tier_ == "auto_merge", first).when(tier_.isin("single_review", "dual_review"), later).otherwise(F.array().cast("array<string>"))


def lowers(tier_: Column, bus: Column, churn: Column) -> Column:
    single = F.array_compact(F.array(F.when(bus, "Adding a second contributor to bus-factor areas"), F.when(churn, "Adding tests for hotspot files")))
    later = F.array(F.lit("Reducing blast radius by narrowing the change scope"), F.lit("Adding test coverage for changed code paths"))
    return F.when(tier_ == "single_review", single).when(tier_.isin("dual_review", "expert_review"), later).otherwise(F.array().cast("array<string>"))


def assemble(changes: DataFrame) -> DataFrame:
    """The verdict of each row with a change_id, an array of signals (or none), and analysed, area_tier, age_hours,
    blast_radius, communities."""
    state, penalty = freshness(F.col("age_hours"))
    none = F.array().cast("array<struct<order:int,description:string,signal_type:string,severity:string,weight:double,source:string>>")
    c = changes.withColumn("signals", F.coalesce("signals", none)).withColumn("freshness", state).withColumn("penalty", penalty)

    def n(severity: str) -> Column:
        return F.size(F.filter("signals", lambda s: s["severity"] == severity))

    def has(kind: str) -> Column:
        return F.exists("signals", lambda s: s["signal_type"] == kind)

    c = c.withColumns({"n_block": n("block"), "n_escalation": n("escalation"), "n_warning": n("warning"), "n_signals": F.size("signals")})
    c = c.withColumn("weight", F.aggregate(F.filter("signals", lambda s: s["severity"].isin("warning", "escalation")), F.lit(0.0), lambda a, s: a + s["weight"]))
    c = c.withColumn("verdict", tier(F.col("n_block"), F.col("n_escalation"), F.col("n_warning"), F.col("area_tier"), F.col("freshness")))
    c = c.withColumn("confidence", F.round(confidence(F.col("analysed"), F.exists("signals", lambda s: s["source"].contains("gitnexus")), F.col("n_signals"), F.col("penalty")), 4))
    c = c.withColumn("distance", F.round(boundary(F.col("verdict"), F.col("n_warning"), F.col("n_escalation"), F.col("weight")), 4))
    # fixed values: the exit code of each tier
    exits = F.create_map(*(F.lit(x) for kv in zip(TIERS, (0, 1, 1, 2, 3), strict=True) for x in kv))
    place = F.array_position(F.array(*map(F.lit, TIERS)), F.col("verdict"))
    grave = F.filter("signals", lambda s: s["severity"].isin("escalation", "block"))
    c = c.withColumns({
        "exit_code": F.coalesce(exits[F.col("verdict")], F.lit(4)), "should_block": F.col("verdict") == "block",
        "next_verdict": named(F.least(place, F.lit(4)).cast("int"), TIERS), "reasons": F.transform(grave, lambda s: s["description"]),
        "raises": raises(F.col("verdict")), "lowers": lowers(F.col("verdict"), has("bus_factor"), has("churn_rate")),
    })
    labels = F.array(
        F.when(F.col("verdict") == "auto_merge", "auto-approvable").when(F.col("verdict") == "block", "blocked"),
        F.when(has("security_finding"), "needs-security-review"),
        F.when(has("bus_factor"), "bus-factor-risk"),
        F.when(F.col("blast_radius") > 20, "high-blast-radius"),
        F.when(F.col("communities") > 2, "cross-cutting"),
    )
    return c.withColumn("labels", F.array_join(F.array_compact(labels), ","))


def comment(v: DataFrame) -> DataFrame:
    """(change_id, comment): the verdict as markdown, of assembled rows with an array ``reviewers`` of lines."""
    # fixed values: the marks of severities
    marks = F.create_map(*(F.lit(x) for kv in {"info": "(i)", "warning": "(!)", "escalation": "(!!)", "block": "[BLOCK]"}.items() for x in kv))
    percent = lambda x: F.concat(F.bround(x * 100, 0).cast("int"), F.lit("%"))

    def section(title: str, lines: Column) -> Column:
        head = F.array(F.lit(f"### {title}"), F.lit(""))
        return F.when(F.size(lines) > 0, F.concat(head, lines, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))

    head = F.array(F.concat(F.lit("## Verdict: `"), "verdict", F.lit("`")), F.lit(""), F.concat(F.lit("**Confidence:** "), percent(F.col("confidence")), F.lit(" | **Data freshness:** "), "freshness"))
    old = F.when(F.col("freshness") != "current", F.array(F.concat(F.lit("> **Warning:** Analysis data is "), "freshness", F.lit(". Consider indexing again.")))).otherwise(F.array().cast("array<string>"))
    counts = F.array(F.lit(""), F.concat(F.lit("**"), "n_files", F.lit("** files changed | **"), "blast_radius", F.lit("** upstream dependents | **"), "communities", F.lit("** communities affected")), F.lit(""))
    signals = section("Signals", F.transform("signals", lambda s: F.concat(F.lit("- "), marks[s["severity"]], F.lit(" **"), s["signal_type"], F.lit("**: "), s["description"])))
    why = section("Why this verdict", F.transform("reasons", lambda r: F.concat(F.lit("- "), r)))
    who = section("Recommended reviewers", F.transform(F.coalesce("reviewers", F.array().cast("array<string>")), lambda r: F.concat(F.lit("- "), r)))
    way = F.array(F.concat(F.lit("This verdict is **"), percent(F.col("distance")), F.lit("** of the way to `"), "next_verdict", F.lit("`.")))
    down = F.when(F.size("lowers") > 0, F.concat(F.array(F.lit(""), F.lit("To de-escalate:")), F.transform("lowers", lambda x: F.concat(F.lit("- "), x)))).otherwise(F.array().cast("array<string>"))
    near = F.when(F.col("distance") > 0.3, section("Borderline verdict", F.concat(way, down))).otherwise(F.array().cast("array<string>"))
    return v.select("change_id", F.array_join(F.concat(head, old, counts, signals, why, who, near, F.array(F.lit("---"))), "\n").alias("comment"))
