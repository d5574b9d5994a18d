"""Change-history queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.operators import history as H
from strataq.operators.asof import as_of
from strataq.operators.ranking import newest, percent, top_per, with_total
from strataq.plans.registry import query
from strataq.sources.tables import Tables, sql

_HOT = """, cw AS (SELECT hash, row_number() OVER (ORDER BY date DESC, hash DESC) AS place FROM commits QUALIFY place <= {n}),
cf AS (SELECT hash, path, place FROM commit_files JOIN cw USING (hash)),
per AS (SELECT path, count(*) AS commits, min(place) AS seen FROM cf GROUP BY 1)
SELECT path, commits, (SELECT count(DISTINCT hash) FROM cf) AS commit_count, (SELECT count(DISTINCT path) FROM cf) AS unique_files,
round_even(100.0::DOUBLE * commits / (SELECT count(DISTINCT hash) FROM cf), 1) AS percentage FROM per ORDER BY commits DESC, seen, path LIMIT 30"""


@query("git_hotspots", sql("commits commit_files", _HOT.format(n=50)))
def git_hotspots(t: Tables) -> DataFrame:
    return H.hotspots(t.commits(), t.commit_files, limit=50)


@query("index_hotspots", sql("commits commit_files", _HOT.format(n=200)))
def index_hotspots(t: Tables) -> DataFrame:
    return H.hotspots(t.commits(), t.commit_files, limit=200)


def _target(t: Tables) -> DataFrame:
    """The path with most commits of all."""
    return t.commit_files().groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").limit(1)


_TARGET = ", target AS (SELECT path FROM commit_files GROUP BY 1 ORDER BY count(*) DESC, path LIMIT 1)"


@query("git_cochanges", sql("commits commit_files", _TARGET + """,
tc AS (SELECT hash, row_number() OVER (ORDER BY date DESC, hash DESC) AS place FROM commits WHERE hash IN (SELECT hash FROM commit_files WHERE path IN (FROM target)) QUALIFY place <= 100),
per AS (SELECT path, count(*) AS n, min(place) AS seen FROM commit_files JOIN tc USING (hash) WHERE path NOT IN (FROM target) GROUP BY 1)
SELECT path, n AS count, round_even(100.0::DOUBLE * n / (SELECT count(*) FROM tc), 1) AS percentage, (SELECT count(*) FROM tc) AS total_commits FROM per ORDER BY n DESC, seen, path LIMIT 50"""))
def git_cochanges(t: Tables) -> DataFrame:
    return H.cochanges(t.commits(), t.commit_files(), _target(t))


@query("git_contributors", sql("commits", """, w AS (SELECT * FROM commits ORDER BY date DESC, hash DESC LIMIT 100)
SELECT author, count(*) AS commits, min(date)::VARCHAR AS first_commit, max(date)::VARCHAR AS last_commit, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM w), 1) AS percentage FROM w GROUP BY 1"""))
def git_contributors(t: Tables) -> DataFrame:
    return H.contributors(t.commits())


@query("git_blame_summary", """WITH n AS (SELECT l_partkey AS path, l_suppkey AS author, count(*) AS lines, max(CAST(l_shipdate AS DATE))::VARCHAR AS last_commit_date FROM lineitem GROUP BY 1, 2)
SELECT *, round_even(100.0::DOUBLE * lines / sum(lines) OVER (PARTITION BY path), 1) AS percentage FROM n""")
def git_blame_summary(t: Tables) -> DataFrame:
    return H.blame_summary(t.lineitem.select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("author"), F.to_date("l_shipdate").alias("date")))


@query("git_file_history", sql("commits commit_files", _TARGET + """
SELECT hash, author, date::VARCHAR AS date, message FROM commits WHERE hash IN (SELECT hash FROM commit_files WHERE path IN (FROM target)) ORDER BY commits.date DESC, hash DESC LIMIT 20"""))
def git_file_history(t: Tables) -> DataFrame:
    own = t.commit_files().join(F.broadcast(_target(t).select("path")), "path", "left_semi")
    return newest(t.commits().join(own, "hash", "left_semi"), 20, *H.recent()).select("hash", "author", F.col("date").cast("string").alias("date"), "message")


@query("git_recent_commits", sql("commits commit_files", """, w AS (SELECT * FROM commits ORDER BY date DESC, hash DESC LIMIT 30)
SELECT hash, author, date::VARCHAR AS date, message, (SELECT count(*) FROM commit_files c WHERE c.hash = w.hash) AS files_changed FROM w"""))
def git_recent_commits(t: Tables) -> DataFrame:
    w = newest(t.commits(), 30, *H.recent())
    n = t.commit_files(w).groupBy("hash").agg(F.count(F.lit(1)).alias("files_changed"))
    return w.join(n, "hash", "left").select("hash", "author", F.col("date").cast("string").alias("date"), "message", F.coalesce("files_changed", F.lit(0)).alias("files_changed"))


_TOP10 = _HOT.format(n=200).rpartition("SELECT path, commits")[0] + ", src AS (SELECT path FROM per ORDER BY commits DESC, seen, path LIMIT 10)" + """,
own AS (SELECT path AS source, hash, row_number() OVER (PARTITION BY path ORDER BY date DESC, hash DESC) AS place FROM commit_files JOIN commits USING (hash) WHERE path IN (FROM src) QUALIFY place <= 100),
pair AS (SELECT source, path AS target, count(*) AS n, min(place) AS seen FROM own JOIN commit_files USING (hash) WHERE source <> path GROUP BY 1, 2),
ranked AS (SELECT source, target, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, seen, target) AS rank FROM pair QUALIFY rank <= 50)"""


def _top10(t: Tables) -> DataFrame:
    hot = H.hotspots(t.commits(), t.commit_files, limit=200, top=10)
    return H.cochange_counts(t.commits(), t.commit_files(), hot)


@query("cochange_top10", sql("commits commit_files", _TOP10 + " SELECT source, target, n AS count, rank::BIGINT AS rank FROM ranked"))
def cochange_top10(t: Tables) -> DataFrame:
    return _top10(t).select("source", "target", F.col("n").alias("count"), F.col("rank").cast("long").alias("rank"))


@query("most_coupled_pairs", sql("commits commit_files", _TOP10 + " SELECT source, target, n AS count, concat(source, ' <-> ', target) AS pair FROM ranked WHERE rank <= 3 ORDER BY n DESC, source, rank LIMIT 5"))
def most_coupled_pairs(t: Tables) -> DataFrame:
    top = _top10(t).where("rank <= 3").orderBy(F.desc("n"), "source", "rank").limit(5)
    return top.select("source", "target", F.col("n").alias("count"), F.concat("source", F.lit(" <-> "), "target").alias("pair"))


@query("cochange_pairs", sql("commits commit_files", """, w AS (SELECT hash FROM commits ORDER BY date DESC, hash DESC LIMIT 500), cf AS (SELECT * FROM commit_files WHERE hash IN (FROM w))
SELECT a.path AS path_a, b.path AS path_b, count(*) AS count FROM cf a JOIN cf b USING (hash) WHERE a.path < b.path GROUP BY 1, 2"""))
def cochange_pairs(t: Tables) -> DataFrame:
    w = newest(t.commits().select("hash", "date"), 500, *H.recent())
    cf = t.commit_files(w)
    return cf.withColumnRenamed("path", "path_a").join(cf.withColumnRenamed("path", "path_b"), "hash").where("path_a < path_b").groupBy("path_a", "path_b").agg(F.count(F.lit(1)).alias("count"))


@query("coupling_bands", sql("commits commit_files", _TARGET + """,
tc AS (SELECT hash FROM commit_files WHERE path IN (FROM target)),
per AS (SELECT path, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM tc), 1) AS p FROM commit_files WHERE hash IN (FROM tc) AND path NOT IN (FROM target) GROUP BY 1)
SELECT CASE WHEN p > 50 THEN 'strong' WHEN p >= 20 THEN 'moderate' ELSE 'weak' END AS band, count(*) AS files FROM per GROUP BY 1"""))
def coupling_bands(t: Tables) -> DataFrame:
    target = F.broadcast(_target(t).select("path"))
    tc = t.commit_files().join(target, "path", "left_semi").select("hash")
    per = t.commit_files().join(tc, "hash", "left_semi").join(target, "path", "left_anti").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    p = with_total(per, tc.agg(F.count(F.lit(1)).alias("all"))).withColumn("p", percent(F.col("n"), F.col("all")))
    return p.groupBy(F.when(F.col("p") > 50, "strong").when(F.col("p") >= 20, "moderate").otherwise("weak").alias("band")).agg(F.count(F.lit(1)).alias("files"))


_DIRS = ", d AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS file_count FROM paths GROUP BY 1 HAVING count(*) > 5)"


@query("dir_file_counts", sql("paths", _DIRS + " SELECT dir, file_count FROM d ORDER BY file_count DESC, dir LIMIT 20"))
def dir_file_counts(t: Tables) -> DataFrame:
    return H.folder_sizes(t.paths())


_SOLE = """, sw AS (SELECT hash, author FROM commits ORDER BY date DESC, hash DESC LIMIT 200),
sole AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(DISTINCT path) AS file_count, count(DISTINCT author) AS contributors FROM commit_files JOIN sw USING (hash) GROUP BY 1 HAVING count(DISTINCT author) <= 1)"""


def sole_folders(t: Tables, window: int = 200, most: int = 1) -> DataFrame:
    """Folders that at most ``most`` authors changed in the newest ``window`` commits."""
    w = newest(t.commits().select("hash", "author", "date"), window, *H.recent())
    cf = t.commit_files(w)
    return H.bus_factor(w, cf, H.folder_sizes(cf.select("path").distinct(), over=0, top=None), most=most)


@query("bus_factor_risks", sql("commits commit_files", _SOLE + " SELECT dir, file_count, contributors, concat(dir, ' (', contributors, ' contributor, ', file_count, ' files)') AS risk FROM sole"))
def bus_factor_risks(t: Tables) -> DataFrame:
    return sole_folders(t)


@query("repo_totals", sql("commits paths", """SELECT (SELECT count(*) FROM commits) AS total_commits, (SELECT count(DISTINCT author) FROM commits) AS contributors, (SELECT count(*) FROM paths) AS files"""))
def repo_totals(t: Tables) -> DataFrame:
    c = t.commits().agg(F.count(F.lit(1)).alias("total_commits"), F.countDistinct("author").alias("contributors"))
    return with_total(c, t.paths().agg(F.count(F.lit(1)).alias("files")))


@query("recommend_reviewers", sql("commits commit_files change_sets", """, own AS (SELECT change_id, path FROM change_sets QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY path) <= 5),
log AS (SELECT path, author FROM commit_files JOIN commits USING (hash) QUALIFY row_number() OVER (PARTITION BY path ORDER BY date DESC, hash DESC) <= 10),
per AS (SELECT change_id, author AS identity, count(*) AS n FROM own JOIN log USING (path) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY count(*) DESC, author) <= 3)
SELECT change_id, identity, CASE WHEN n >= 3 THEN 'recent_contributor' ELSE 'area_expert' END AS reason, least(0.9::DOUBLE, n / 10.0::DOUBLE) AS confidence FROM per"""))
def recommend_reviewers(t: Tables) -> DataFrame:
    return H.reviewers(t.commits(), t.commit_files(), t.change_sets()).drop("n")


@query("hot_changed_files", sql("commits commit_files change_sets", _HOT.format(n=200).rpartition("SELECT path, commits")[0] + """, hot AS (SELECT path FROM per ORDER BY commits DESC, seen, path LIMIT 10)
SELECT change_id, path FROM change_sets WHERE path IN (FROM hot)"""))
def hot_changed_files(t: Tables) -> DataFrame:
    hot = H.hotspots(t.commits(), t.commit_files, limit=200, top=10).select("path")
    return t.change_sets().join(F.broadcast(hot), "path", "left_semi").select("change_id", "path")


@query("commits_since_index", sql("commits", "SELECT author, count(*) AS commits FROM commits WHERE date > (SELECT max(date) - 30 FROM commits) GROUP BY 1"))
def commits_since_index(t: Tables, days: int = 30) -> DataFrame:
    """Commits of each author in the ``days`` up to the newest commit."""
    c = t.commits()
    last = c.agg(F.max("date").alias("last"))
    return with_total(c, last).where(F.col("date") > F.date_sub("last", days)).groupBy("author").agg(F.count(F.lit(1)).alias("commits"))


@query("commits_since_own_index", sql("commits", """, run AS (SELECT author, max(date) FILTER (message = '1-URGENT') AS last, count(DISTINCT date) FILTER (message = '1-URGENT') AS runs FROM commits GROUP BY 1)
SELECT author, last::VARCHAR AS last_index, runs, (count(*) FILTER (last IS NULL OR date > last))::BIGINT AS commits_since, count(*) FILTER (runs > 0 AND date < (SELECT min(c.date) FROM commits c WHERE c.author = commits.author AND c.message = '1-URGENT')) AS before_any FROM commits JOIN run USING (author) GROUP BY 1, 2, 3"""))
def commits_since_own_index(t: Tables) -> DataFrame:
    """Commits of each author's repository since its own newest index run (urgent commits stand for these), all of them
    where it has none; and how many were made before its first."""
    c = t.commits()
    runs = c.where("message = '1-URGENT'").select("author", "date").distinct()
    last = runs.groupBy("author").agg(F.max("date").alias("last"), F.count(F.lit(1)).alias("runs"))
    found = as_of(c.select("author", "date", "hash"), runs.withColumn("run", F.col("date")), ["author"], "date", ["run"], width="YEAR")
    found = found.join(last, "author", "left")
    since = F.col("last").isNull() | ((F.col("last_run") == F.col("last")) & (F.col("date") > F.col("last")))
    out = found.groupBy("author", F.col("last").cast("string").alias("last_index"), F.coalesce("runs", F.lit(0)).alias("runs"))
    return out.agg(F.count_if(since).alias("commits_since"), F.count_if(F.col("last").isNotNull() & F.col("last_run").isNull()).alias("before_any"))


@query("git_evolution_contributors", sql("commits", "SELECT author, count(*) AS commits FROM commits GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"))
def git_evolution_contributors(t: Tables) -> DataFrame:
    return t.commits().groupBy("author").agg(F.count(F.lit(1)).alias("commits")).orderBy(F.desc("commits"), "author").limit(20)


@query("newest_commit_per_file", sql("commits commit_files", "SELECT path, hash, author, date::VARCHAR AS date FROM commit_files JOIN commits USING (hash) QUALIFY row_number() OVER (PARTITION BY path ORDER BY commits.date DESC, hash DESC) = 1"))
def newest_commit_per_file(t: Tables) -> DataFrame:
    j = t.commit_files().join(t.commits(), "hash")
    return top_per(j, ["path"], 1, *H.recent()).select("path", "hash", "author", F.col("date").cast("string").alias("date"))
