"""Queries on keys and tables larger than those of the given folders."""

import itertools
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from tests.harness import difference

from strataq.operators import risk as R
from strataq.plans.registry import ORACLES, QUERIES


def orders(folder, keys):
    """An ``orders.parquet`` of these customers, and DuckDB over it."""
    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT row_number() OVER () - 1 AS o_orderkey, k::BIGINT AS o_custkey FROM unnest(?::BIGINT[]) u(k)", [keys])
    con.execute(f"COPY orders TO '{folder}/orders.parquet' (FORMAT parquet)")
    return con


def test_days_beyond_year_9999(spark, tmp_path):
    con = orders(tmp_path, [0, 1, 14_999, 31_998, 31_999, 90_000, 899_999, 1_100_000, None, -1, -7_700, -7_770, -7_780, -30_000])
    got = QUERIES["epoch_dates"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(con.execute(ORACLES["epoch_dates"]).fetchall())


def test_days_beyond_any_timestamp(spark, tmp_path):
    """The SQL's timestamps end at customer 1,164,729; days go on by the calendar, 400 years being 146,097 of them."""
    orders(tmp_path, [5_400_000, 30_000_000, 10**12, 146_097 * 432, 146_097 * 432 * 5 + 14_999])
    got = [r.day for r in sorted(QUERIES["epoch_dates"](spark, str(tmp_path)).collect(), key=lambda r: r.o_orderkey)]
    assert got == ["1357062-11-07", "7530263-08-10", "250943122205-06-10", "15839970-01-01", "79195733-11-23"]


def broadcast_tables(df):
    """The tables that a plan sends whole, without a sum or a limit on the way, to the driver and from there to all tasks."""
    lines, found = df._jdf.queryExecution().executedPlan().toString().split("\n"), set()
    depth = lambda x: re.search(r"[^ :+|*-]", x).start() if x.strip() else 0
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = "\n".join(itertools.takewhile(lambda x: depth(x) > depth(line), lines[i + 1 :]))
            if not re.search("Aggregate|TakeOrdered|Limit", below):
                found |= set(re.findall(r"(\w+)\.parquet\]", below))
    return found


@pytest.mark.parametrize("name", ["compute_verdict", "review_comment", "suggest_labels"])
def test_verdicts_broadcast_no_growing_table(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert broadcast_tables(df) <= {"nation", "region"}


def test_areas_are_sent_to_the_paths(spark):
    paths = spark.range(3).selectExpr("id AS p_partkey", "concat('Brand#', id, '/Kind x/part') AS path")
    areas = spark.createDataFrame([("brand#1/kind", "block"), ("kind", None), ("nowhere", "block")], "area string, recommendation string")
    changes = spark.createDataFrame([(7, 1), (8, 2), (9, 5)], "change_id long, p_partkey long")
    near = R.areas_of(changes, paths, areas)
    assert sorted(map(tuple, near.collect()), key=str) == [(7, "brand#1/kind", "block"), (7, "kind", None), (8, "kind", None)]
    assert "BroadcastNestedLoopJoin BuildRight" in near._jdf.queryExecution().executedPlan().toString()


def test_registry_writes_no_file_for_each_artifact(spark, tmp_path):
    con, n = duckdb.connect(), 1500
    con.execute(f"CREATE TABLE supplier AS SELECT range AS s_suppkey FROM range({n})")
    con.execute(f"CREATE TABLE lineitem AS SELECT range % {n} AS l_suppkey, (range // {n} + 1)::INT AS l_linenumber, ['A', 'N'][range % 7 % 2 + 1] AS l_returnflag FROM range({3 * n})")
    for table in ("supplier", "lineitem"):
        con.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = sum(1 for _ in shared.rglob("*"))
    assert difference(QUERIES["registry_artifacts"](spark, str(tmp_path)), con, ORACLES["registry_artifacts"]) == ""
    assert sum(1 for _ in shared.rglob("*")) - before < n


@pytest.mark.parametrize("block", [16_384, 7])
def test_nearest_vectors(spark, monkeypatch, tmp_path, block):
    """Copies, near ties, vectors along a query and vectors without a similarity, in one block and in many."""
    r = np.random.default_rng(5)
    e = r.normal(size=(160, 8)).astype(np.float32)
    e[20:60] = e[0]
    e[60:80] = e[1] * np.linspace(0.5, 2, 20, dtype=np.float32)[:, None]
    e[80:100] = e[2] + r.normal(size=(20, 8)).astype(np.float32) * 1e-3
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(e)] + [(200, None), (201, [0.0] * 8)]
    monkeypatch.setattr("strataq.operators.nearest.VECTORS", block)
    monkeypatch.setattr("strataq.operators.nearest.QUERIES", block)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    df = QUERIES["embedding_topk"](spark, str(tmp_path))
    assert difference(df, con, ORACLES["embedding_topk"]) == ""
    assert "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().executedPlan().toString()
