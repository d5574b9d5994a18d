"""Kept tables, the registry, snapshots as files and keyed stream state."""

import random

import pytest
from pyspark.sql import functions as F

from strataq.operators import risk as R
from strataq.operators.registry import Registry, listing
from strataq.plans import session as P
from strataq.sources.snapshots import read_snapshots, write_snapshots
from strataq.sources.tables import Tables, tool_calls
from strataq.sources.versions import VersionedTable
from strataq.streaming import sessions as S
from strataq.streaming.trends import TrendFollower

SMALLEST = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, path, buckets=4):
    return VersionedTable(spark, str(path), ["k", "b"], buckets)


def frame(spark, *data):
    return spark.createDataFrame(list(data), "k long, b string, v int")


def test_merges_and_versions(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.version == 0 and t.read() is None
    assert t.merge(frame(spark, *((i, "x", i) for i in range(20)), (None, "x", -1)), batch=1)
    first = rows(t.read())
    assert t.merge(frame(spark, (3, "x", 33), (3, "y", 34), (50, "x", 50)), batch=2)
    want = [r for r in first if r[:2] != (3, "x")] + [(3, "x", 33), (3, "y", 34), (50, "x", 50)]
    assert rows(t.read()) == sorted(want, key=str) and rows(t.read(1)) == first
    assert not t.merge(frame(spark, (3, "x", 99)), batch=2) and not t.merge(frame(spark, (3, "x", 99)), batch=1) and t.version == 2
    assert t.delete(frame(spark, (50, "x", 0), (777, "no", 0)))
    assert rows(t.read()) == sorted((r for r in want if r[0] != 50), key=str)
    assert t.merge(frame(spark), batch=9) and rows(t.read()) == sorted((r for r in want if r[0] != 50), key=str)
    t.vacuum(keep=1)
    assert t.versions() == [4] and rows(t.read()) == sorted((r for r in want if r[0] != 50), key=str)
    assert t.delete(t.read()) and t.read().count() == 0 and t.read().columns == ["k", "b", "v"]


def test_a_merge_that_fails_is_never_read(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t")
    t.merge(frame(spark, (1, "x", 1), (2, "x", 2)), batch=1)
    before = rows(t.read())
    monkeypatch.setattr(t, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.merge(frame(spark, (1, "x", 100)), batch=2)
    again = table(spark, tmp_path / "t")
    assert rows(again.read()) == before
    assert again.merge(frame(spark, (1, "x", 7)), batch=2) and rows(again.read()) == [(1, "x", 7), (2, "x", 2)]  # retried over what was left


def test_two_writers(spark, tmp_path):
    a, b = table(spark, tmp_path / "t"), table(spark, tmp_path / "t")
    a.merge(frame(spark, (1, "x", 1)))

    def slow(old, new):
        a.merge(frame(spark, (2, "x", 2)))  # another merge commits in between
        return b.replaced(old, new)

    with pytest.raises(Exception):
        b.merge(frame(spark, (1, "x", 5)), slow)
    assert rows(a.read()) == [(1, "x", 1), (2, "x", 2)]


def test_registry(spark, tmp_path):
    files = tmp_path / "files"
    for name in ("r1/.code-context/heuristic_summary.json", "r1/.code-context/x.json", "r1/.code-context/sub/a", "r1/.code-context/sub/b", "r1/src/z", "r 2/.code-context/x.json"):
        (files / name).parent.mkdir(parents=True, exist_ok=True)
        (files / name).write_text("{}")
    top = f"file:{files}/"
    found = listing(spark, f"{files}/*/.code-context")
    assert found.count() == 5
    g = Registry(spark, str(tmp_path / "registry"), 2)
    assert g.entries().count() == 0
    repos = spark.createDataFrame([("a", top + "r1", "1"), ("b", top + "r 2", "1"), ("c", top + "none", "1"), ("a", top + "gone", "0"), ("n", None, "1")], "alias string, path string, analyzed_at string")
    assert g.register(repos, found, batch=1)
    assert rows(g.entries().select("alias", "indexed", "artifact_count")) == [("a", True, 3), ("b", False, 1), ("c", False, 0), ("n", False, 0)]
    moved = spark.createDataFrame([("b", top + "r1", "2")], "alias string, path string, analyzed_at string")
    assert g.register(moved, found, batch=2) and not g.register(moved, found, batch=2)
    assert rows(g.by_path(spark.createDataFrame([(top + "r1",), ("zz",)], "path string"))) == [(top + "r1", "a")]
    g.unregister(spark.createDataFrame([("a",), ("zz",)], "alias string"), batch=3)
    assert rows(g.entries().select("alias", "analyzed_at", "artifact_count")) == [("b", "2", 3), ("c", "1", 0), ("n", "1", 0)]


AREA = "area string, seq string, risk_level string, churn_rank long, contributor_count long, test_coverage string"


def snapshots(spark, *data):
    return spark.createDataFrame([(a, s, level, 5, 1, "low") for a, s, level in data], AREA)


def test_snapshot_files(spark, tmp_path):
    folder = tmp_path / "history"
    write_snapshots(snapshots(spark, ("a", "1", "low"), ("b", "1", "high"), ("a", "2", "medium")), str(folder))
    (folder / "risk_3.json").write_text('{\n "timestamp": "3",\n "areas": {"a": {"risk_level": "high", "odd": [1]}, "c": {}}\n}')
    (folder / "risk_4.json").write_text('{"areas": {"a": {"risk_')  # cut off
    (folder / "risk_5.json").write_text("[1, 2]")
    (folder / "risk_6.json").write_text('{"overall_risk": "low"}')
    got = read_snapshots(spark, str(folder))
    assert rows(got.where("area IS NOT NULL").select("area", "seq", "risk_level", "churn_rank", "test_coverage")) == [
        ("a", "risk_1", "low", 5, "low"), ("a", "risk_2", "medium", 5, "low"), ("a", "risk_3", "high", 0, "low"), ("b", "risk_1", "high", 5, "low"), ("c", "risk_3", "medium", 0, "low"),
    ]
    assert sorted(r.file.rsplit("/", 1)[1] for r in got.where("area IS NULL").collect()) == ["risk_4.json", "risk_5.json", "risk_6.json"]
    assert rows(R.trends(got.where("area = 'a'")).select("risk_trend", "projected_risk")) == [("degrading", "critical")]


def test_trends_follow_a_folder(spark, tmp_path):
    """Snapshots out of order, late, damaged and repeated, over a restart; a batch that is replayed changes nothing."""
    r = random.Random(8)
    data = [(f"area{a}", f"{d:02}", r.choice(R.RISKS)) for a in range(6) for d in range(14) if r.random() < 0.8]
    folder, state = tmp_path / "in", str(tmp_path / "state")
    follow = lambda: TrendFollower(spark, str(folder), state, buckets=2, files_per_batch=3)
    days = sorted({d for _, d, _ in data}, key=lambda _: r.random())
    for k, part in enumerate((days[:5], days[5:])):
        write_snapshots(snapshots(spark, *(x for x in data if x[1] in part)), str(folder))
        (folder / f"risk_bad{k}.json").write_text("{")
        follow().catch_up()
    f = follow()
    names = R.trends(snapshots(spark, data[0])).columns
    want = rows(R.trends(snapshots(spark, *data)).select(names))
    assert rows(f.trends().select(names)) == want and f.damaged.read().count() == 2
    version = f.areas.version
    f.catch_up()
    replayed = snapshots(spark, ("area0", "99", "critical")).withColumns({"file": F.lit("x"), "blast_radius": F.lit(0).cast("long")})
    f.apply(replayed, 0)  # a batch that was taken in before
    assert f.areas.version == version and rows(f.trends().select(names)) == want


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Events of the smallest table in files in which they come shuffled, the second half of the files apart."""
    top, events = tmp_path_factory.mktemp("sessions"), Tables(spark, SMALLEST).events
    for k in range(4):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == k).orderBy(F.xxhash64("event_id", F.lit(7))).coalesce(1).write.mode("append").parquet(str(top / ("one" if k < 2 else "two")))
    end = events.agg(F.max("ts").alias("ts")).select(F.col("ts") + F.expr("INTERVAL 900 DAYS")).first()[0]
    spark.createDataFrame([(None, end, -1, None, None, None)], events.schema).coalesce(1).write.mode("append").parquet(str(top / "two"))
    return top, events.schema


def test_session_state_of_a_stream(spark, shuffled):
    top, schema = shuffled
    known = dict(phases=dict(P.PHASES), prefixes=P.PREFIXES, other=3, late="800 days")

    def run(part):
        # the same query over a folder to which files come, stopped and started again
        target = top / "in"
        target.mkdir(exist_ok=True)
        for f in (top / part).glob("*.parquet"):
            (target / f"{part}-{f.name}").write_bytes(f.read_bytes())
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(target))
        S.run(tool_calls(source), str(top / "out"), str(top / "check"), **known)

    run("one")
    run("two")
    out, t = spark.read.parquet(str(top / "out")).where("session >= 0"), Tables(spark, SMALLEST)
    same = lambda a, b, c: rows(a.select(c)) == rows(b.select(c))
    assert same(S.phases(out), P.phase_transitions(t), ["session", "phase", "started", "completed"])
    assert same(S.calls(out), P.tool_call_pairs(t), ["session", "started", "ended", "tool", "result"])
    assert same(S.states(out), P.session_state(t), ["session", "calls", "errors", "successes", "longest", "tools"])
    ring = {r.session: set(r.discoveries) for r in S.states(out).collect()}
    want = {}
    for r in P.discovery_ring(t).collect():
        want.setdefault(r.session, set()).add(r.seq)
    assert ring == want


def test_idle_sessions_are_closed(spark, tmp_path):
    schema = "session long, seq long, ts timestamp, tool string, status string, result string"
    parts = [[(1, 1, "2024-01-01 00:00:00"), (2, 2, "2024-01-01 00:00:01")], [(2, 3, "2024-01-03 00:00:00")], [(1, 4, "2024-01-05 00:00:00"), (9, 5, "2024-01-09 00:00:00")], [(9, 6, "2024-02-01 00:00:00")]]
    known = dict(phases=dict(P.PHASES), prefixes=P.PREFIXES, other=3, late="1 minute", idle_ms=86_400_000)
    for k, part in enumerate(parts):
        spark.createDataFrame([(s, q, t) for s, q, t in part], "session long, seq long, t string").selectExpr("session", "seq", "CAST(t AS timestamp) AS ts", "'shell' AS tool", "'completed' AS status", "CAST(NULL AS string) AS result").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        S.run(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), **known)
    got = rows(spark.read.parquet(str(tmp_path / "out")).where("kind = 'state' AND session < 9").select("session", "calls", "discoveries"))
    assert got == [(1, 1, [1]), (1, 1, [4]), (2, 1, [2]), (2, 1, [3])]  # after a day of silence a session begins anew
