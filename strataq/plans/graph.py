"""Reachability and communities over a symbol graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.operators.ranking import with_total
from strataq.operators.reach import estimated, reached
from strataq.plans.registry import query
from strataq.sources.tables import Tables, sql

DEPTH = 3


def edges(t: Tables) -> DataFrame:
    """Calls (src, dst): parts of one brand, a module, in successive lines of an order."""
    part = t.part.select("p_partkey", "p_brand")
    line = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey")
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("p_partkey").alias("dst"), "p_brand")
    return line.withColumnRenamed("p_partkey", "src").join(after, ["l_orderkey", "l_linenumber", "p_brand"]).where("src <> dst").select("src", "dst").distinct()


_EDGES = "edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN part p ON p.p_partkey = a.l_partkey JOIN part r ON r.p_partkey = b.l_partkey AND r.p_brand = p.p_brand WHERE a.l_partkey <> b.l_partkey)"


_WALK = f"WITH RECURSIVE {_EDGES}, walk AS (SELECT DISTINCT dst AS root, dst AS node, 0 AS depth FROM edges UNION SELECT root, src, depth + 1 FROM walk JOIN edges ON dst = node WHERE depth < {DEPTH}), best AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY 1, 2)"


def _walk(t: Tables) -> DataFrame:
    e = edges(t)
    return reached(e.select(F.col("dst").alias("root")).distinct(), e, DEPTH)


@query("blast_radius", _WALK + " SELECT root, count(*) - 1 AS upstream, max(depth) AS depth FROM best GROUP BY 1")
def blast_radius(t: Tables) -> DataFrame:
    return _walk(t).groupBy("root").agg((F.count(F.lit(1)) - 1).alias("upstream"), F.max("depth").alias("depth"))


@query("blast_radius_decay", _WALK + " SELECT root, round(sum(CASE WHEN depth = 0 THEN 0 ELSE 1.0::DOUBLE / (1 << depth) END), 6) AS score FROM best GROUP BY 1")
def blast_radius_decay(t: Tables) -> DataFrame:
    """An extension: callers count half as much with each step."""
    return _walk(t).groupBy("root").agg(F.round(F.sum(F.when(F.col("depth") == 0, 0.0).otherwise(1 / F.pow(F.lit(2.0), F.col("depth")))), 6).alias("score"))


@query("blast_radius_estimated", _WALK + " SELECT root, CASE WHEN root % 50 = 0 THEN count(*) - 1 END AS upstream, CASE WHEN root % 50 = 0 THEN true END AS near FROM best GROUP BY 1")
def blast_radius_estimated(t: Tables) -> DataFrame:
    """All roots by sketches; those of a stated set (ids divisible by 50) exactly too, and whether the estimate is near:
    within 8 %, five standard errors."""
    e = edges(t)
    every = estimated(e, DEPTH).join(e.select(F.col("dst").alias("root")).distinct(), "root", "left_semi").withColumnRenamed("upstream", "about")
    asked = e.select(F.col("dst").alias("root")).distinct().where("root % 50 = 0")
    exact = reached(asked, e, DEPTH).groupBy("root").agg((F.count(F.lit(1)) - 1).alias("upstream"))
    near = F.abs(F.col("about") - F.col("upstream")) <= F.greatest(F.lit(1.0), 0.08 * F.col("upstream"))
    return every.join(exact, "root", "left").select("root", "upstream", near.alias("near"))


@query("graph_stats", f"WITH {_EDGES} SELECT (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS nodes")
def graph_stats(t: Tables) -> DataFrame:
    e = edges(t)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("n")).agg(F.countDistinct("n").alias("nodes"))
    return with_total(e.agg(F.count(F.lit(1)).alias("edges")), nodes)


@query("symbol_context", f"WITH {_EDGES} SELECT n, sum(i)::BIGINT AS callers, sum(o)::BIGINT AS callees FROM (SELECT dst AS n, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges) GROUP BY 1")
def symbol_context(t: Tables) -> DataFrame:
    e = edges(t)
    both = e.select(F.explode(F.array(F.struct(F.col("dst").alias("n"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("n"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    return both.groupBy("x.n").agg(F.sum("x.i").alias("callers"), F.sum("x.o").alias("callees"))


@query("top_communities", sql("symbols", "SELECT community, count(*) AS symbols, round_even(count(*) / (SELECT count(*) FROM symbols)::DOUBLE, 3) AS cohesion FROM symbols GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def top_communities(t: Tables) -> DataFrame:
    s = t.symbols()
    per = with_total(s.groupBy("community").agg(F.count(F.lit(1)).alias("symbols")), s.agg(F.count(F.lit(1)).alias("of")))
    return per.select("community", "symbols", F.bround(F.col("symbols") / F.col("of"), 3).alias("cohesion")).orderBy(F.desc("symbols"), "community").limit(10)


@query("cross_repo_impact", sql("symbols", "SELECT a.community AS provider, b.community AS consumer, count(*) AS contracts FROM symbols a JOIN symbols b ON a.process = b.process AND a.community <> b.community GROUP BY 1, 2"))
def cross_repo_impact(t: Tables) -> DataFrame:
    """An extension: communities of one process, counted per community first so that pairs are of communities."""
    per = t.symbols().groupBy("process", "community").agg(F.count(F.lit(1)).alias("n"))
    a, b = per.toDF("process", "provider", "n"), per.toDF("process", "consumer", "m")
    return a.join(b, "process").where("provider <> consumer").groupBy("provider", "consumer").agg(F.sum(F.col("n") * F.col("m")).alias("contracts"))
