"""As-of joins, reach by sketches, sorted lists, artifacts of odd shapes, manifests and long paths."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from strataq.operators import artifacts as A
from strataq.operators import manifests as M
from strataq.operators import reach
from strataq.operators.asof import as_of
from strataq.plans import joins, narrative, sections
from strataq.sources.lists import read_sorted, write_sorted
from strataq.sources.tables import Tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("width", ["HOUR", "YEAR"])
def test_as_of(spark, width):
    r = random.Random(5)
    day = lambda: f"2024-{r.randint(1, 12):02}-{r.randint(1, 28):02} {r.randint(0, 23):02}:00:00"
    left = [(i, r.choice(["a", "b", "hot", "hot", "hot"]), day()) for i in range(200)] + [(900, None, day()), (901, "a", None), (902, "alone", day())]
    right = [(r.choice(["a", "b", "hot"]), day(), k) for k in range(60)] + [(None, day(), 77), ("a", None, 78), ("hot", "2024-06-01 00:00:00", 80), ("hot", "2024-06-01 00:00:00", 81)]
    left.append((903, "hot", "2024-06-01 00:00:00"))
    a = spark.createDataFrame(left, "id long, k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    b = spark.createDataFrame(right, "k string, t string, v long").withColumn("t", F.col("t").cast("timestamp"))
    got = {r.id: r.last_v for r in as_of(a, b, ["k"], "t", ["v"], width=width).collect()}
    want = {}
    for i, k, t in left:
        near = [(rt, v) for rk, rt, v in right if k is not None and t is not None and rk == k and rt is not None and rt <= t]
        want[i] = max(near)[1] if near else None
    assert got == want
    assert as_of(a, b.where("false"), ["k"], "t", ["v"]).where("last_v IS NOT NULL").count() == 0


def test_bus_factor_of_all_commits(spark, tmp_path):
    """Folders are judged by the whole history: an author before the newest 200 commits counts, and so does a folder that
    nobody changed since; a change of other folders is a row too."""
    paths = [(1, "A", "x", 0), (2, "B", "x", 0), (3, "C", "x", 0)]
    who = {1: 1, 2: 1} | {k: 2 for k in range(3, 303)} | {303: 3}  # commits by customer, in order of time
    files = [(1, 1), (2, 2)] + [(k, 1) for k in range(3, 303)] + [(303, 3), (302, 3)]  # A: 1 and 2, B: 1 alone, C: 2 and 3
    day = F.date_add(F.lit("1999-01-01"), F.col("o_orderkey").cast("int")).cast("timestamp")
    write = lambda name, df: df.write.parquet(f"{tmp_path}/{name}.parquet")
    write("customer", spark.createDataFrame([(k, f"c{k}") for k in (1, 2, 3)], "c_custkey long, c_name string"))
    write("part", spark.createDataFrame(paths, "p_partkey long, p_brand string, p_type string, p_size int"))
    write("orders", spark.createDataFrame([(k, c, "m") for k, c in who.items()], "o_orderkey long, o_custkey long, o_orderpriority string").withColumn("o_orderdate", day))
    write("lineitem", spark.createDataFrame(files, "l_orderkey long, l_partkey long"))
    got = joins.bus_factor_touch(Tables(spark, str(tmp_path))).select("change_id", "areas", "folders", "fewest")
    assert rows(got) == [(1, 1, 2, 1), (2, 0, 2, 2), (3, 0, 1, 2)]


def test_reach(spark):
    """A hub that hundreds call, a chain and a ring: exact for asked roots, sketches for all."""
    pairs = [(i, 0) for i in range(1, 400)] + [(i + 1000, i) for i in range(1, 400)] + [(i + 1, i) for i in range(5000, 5010)] + [(7000, 7001), (7001, 7002), (7002, 7000)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    about = {r.root: r.upstream for r in reach.estimated(e, 3).collect()}
    asked = spark.createDataFrame([(0,), (5000,), (7000,), (5010,)], "root long")
    exact = {r.root: r.n for r in reach.reached(asked, e, 3).groupBy("root").agg((F.count(F.lit(1)) - 1).alias("n")).collect()}
    assert exact == {0: 798, 5000: 3, 7000: 2, 5010: 0}
    assert len(about) == len({n for p in pairs for n in p}) and all(abs(about[k] - n) <= max(1, 0.05 * n) for k, n in exact.items())


def test_sorted_lists(spark, tmp_path):
    r = random.Random(1)
    values = [f"p{r.randint(0, 500):04}/é{i % 7}" for i in range(2000)] + [None, "", "~last"]
    df = spark.createDataFrame([(v,) for v in values], "path string").repartition(5)
    folder = str(tmp_path / "list")
    want = sorted({v for v in values if v is not None}, key=lambda v: v.encode())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files for few rows
    try:
        assert write_sorted(df, F.col("path"), folder) == len(want)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "list").glob("part-*"))
    assert len(files) > 1 and "".join(f.read_text() for f in files) == "".join(v + "\n" for v in want)
    assert rows(read_sorted(spark, folder)) == sorted(enumerate(want, 1), key=str)
    assert write_sorted(df.where("false"), F.col("path"), folder) == 0 and read_sorted(spark, folder).count() == 0


SHAPES = {
    "[]": (0, 0), "[1, 2]": (2, 2), '{"generalDiagnostics": [1, 2, 3], "n": 1}': (3, 3), '{"generalDiagnostics": {"a": [1]}}': (0, 0), '{"a": [1], "b": [2, 3], "c": 4, "d": null}': (0, 3), "7": (0, 0), '"x"': (0, 0), "null": (0, 0), "not json": (0, 0), "": (0, 0), "{}": (0, 0),
}


@pytest.mark.parametrize("text, want", list(SHAPES.items()) + [(None, (0, 0))])
def test_artifact_lists(spark, text, want):
    v = spark.createDataFrame([(text,)], "t string").select(F.try_parse_json("t").alias("v"))
    assert tuple(v.select(A.type_errors(F.col("v")), A.dead_code(F.col("v"))).first()) == want


def test_artifact_entries(spark):
    texts = [{"results": [{"extra": {"severity": "HIGH"}}, {"extra": {"severity": 3}}, {"extra": "x"}, 5, {"extra": {"severity": "weird"}}]}, {"results": 1}, [1], {"f.py": [{"complexity": 4}, {"complexity": "2.5"}, {"name": "n"}, 3], "g.py": {"complexity": 9}}]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(texts)], "id long, t string").withColumn("v", F.try_parse_json("t"))
    assert sorted(r.level for r in A.findings(df).collect()) == ["high", "info", "info", "info", "info"]
    assert rows(A.functions(df).select("id", "file", "complexity")) == [(3, "f.py", 2.5), (3, "f.py", 4.0)]


@pytest.mark.parametrize("file, line, want", [
    ("requirements.txt", "Django>=4.2,<5 ; python_version > '3.8'", ("django", ">=4.2,<5")), ("requirements-dev.txt", "  zope.interface [test] == 5.0  # why", ("zope-interface", "== 5.0")), ("requirements.txt", "flask", ("flask", None)),
    ("requirements.txt", "-r base.txt", None), ("requirements.txt", "# flask", None), ("requirements.txt", "", None), ("requirements.txt", "git+https://x/y.git", None),
    ("pyproject.toml", 'flask = "^2.0"', ("flask", "^2.0")), ("pyproject.toml", '  "SQL_Alchemy>=2",', ("sql-alchemy", ">=2")), ("pyproject.toml", "'a[b]~=1.0; x == \"1\"'", None), ("pyproject.toml", "[project]", None), ("pyproject.toml", "# a = '1'", None), ("pyproject.toml", '"plain"', ("plain", None)),
    ("package.json", '  "@scope/react-dom": "^18.2.0",', ("@scope/react-dom", "^18.2.0")), ("package.json", '  "scripts": {', None), ("package.json", '"react": "1"', ("react", "1")), ("setup.py", "flask>=2", None),
    ("requirements.txt", "a" * 100_000, ("a" * 100_000, None)), ("pyproject.toml", '"a' + " " * 100_000, None), ("package.json", None, None), (None, "flask", None),
])
def test_dependencies(spark, file, line, want):
    got = M.dependencies(spark.createDataFrame([(1, file, line)], "repo long, file string, line string")).select("name", "version").collect()
    assert [tuple(r) for r in got] == ([want] if want else [])


def test_paths_of_texts(spark):
    """As the plain pattern, on texts of its characters; and on a path of 100,000 folders."""
    plain = re.compile(r"(?:\.?/)?(?:[\w.-]+/)+[\w.-]+\.\w+")
    r = random.Random(2)
    texts = ["".join(r.choice(["a", "b1", "é", "/", "/", ".", "-", " ", ".py", "//", "./", "\n"]) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    texts += ["see src/a.py, ./x/y.tar.gz and /etc/b.c", "a" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {x.i: x.p for x in df.select("i", narrative.paths_of(F.col("t")).alias("p")).collect()}
    for i, t in enumerate(texts[:-1]):
        assert got[i] == plain.findall(t), t
    deep = ["d/" * 100_000 + "x.py", "d/" * 100_000, "d/" * 100_000 + "x.py-", "a.b" * 50_000]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(deep)], "area long, content string")
    sizes = {r.area: r.n for r in found.select("area", F.size(narrative.paths_of(F.col("content"))).alias("n")).collect()}
    assert sizes == {0: 1, 1: 0, 2: 1, 3: 0} and narrative.scores(found).count() == 4


def test_views(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError, match="git/coupling"):
        sections.view(t, "other")
    assert {"summary", "verdict", "trends", "scan/all", "git/hotspots"} <= set(sections.VIEWS)
    record = json.loads(sections.view(t, "summary").first().record)
    assert set(record) == {"volume", "health", "git", "complexity", "graph"} and len(record["complexity"]["top_complex_functions"]) == 10
