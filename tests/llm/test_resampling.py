"""Importance resampling against a plain version, and its selection against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strataq.llm import resampling as R
from strataq.llm import words

SCHEMA = "doc_id long, text string, lang string, score string, row long, rank string"


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def buckets(t):
    w = split(t)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


TEXTS = ["Hello wörld A b c 1-2 3", "", None, "x" * 70 + " " + "y" * 200 + " z" + "Q" * 1000 + " a b", "é ü-ß 　 漢字", "  one", "UP " * 50, "a\x00b\nc", "word"]


@pytest.mark.parametrize("block, slice_", [(1 << 20, 1 << 20), (50, 10), (1, 1)])
def test_features(monkeypatch, block, slice_):
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(words, "SLICE", slice_)
    n, found = [0] * len(TEXTS), [[] for _ in TEXTS]
    for a, m, who, bucket in R.features(pa.array(TEXTS, pa.string())):
        for i, x in enumerate(m):
            n[a + i] += int(x)
        for i, x in zip(who.tolist(), bucket.tolist()):
            found[a + i].append(x)
    assert n == [len(split(t)) for t in TEXTS]
    assert [sorted(f) for f in found] == [sorted(buckets(t)) for t in TEXTS]


def fixture():
    r = random.Random(4)
    vocabulary = [f"W{i}é" for i in range(40)] + ["the", "a", "of"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(160)] + TEXTS
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 40 + [(5, "the same id " * 9), (None, texts[7]), (None, None)]
    return rows, [texts[3], "the the a", None]


def plain(rows, target, percent=5, least=20):
    s, t = Counter(b for _, x in rows for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    a, c = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * a) / ((s[b] + 1.0) * c)))
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, buckets(x)))
        out.append((i, len(buckets(x)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(split(x)) >= least))
    able = sorted((-r[3], r[0] is None, r[0] or 0) for r in out if r[4])
    return out, able[: percent * len(able) // 100]


@pytest.mark.parametrize("few, percent", [(20_000, 5), (1, 5), (1, 60), (1, 100), (3, 0)])
def test_draw(spark, few, percent):
    rows, target = fixture()
    docs = spark.createDataFrame([(i, t, "l", "s", 1, "r") for i, t in rows], SCHEMA).repartition(7)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = R.draw(R.scored(docs, bench), percent=percent, few=few).collect()
    want, drawn = plain(rows, target, percent)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(w[:4] for w in want)
    won = sorted((r.rank, (-r.score, r.doc_id is None, r.doc_id or 0)) for r in got if r.rank is not None)
    assert [w[0] for w in won] == list(range(1, len(drawn) + 1))
    assert [w[1] for w in won] == drawn


def test_cutoff_is_the_kth_key(spark):
    r = random.Random(9)
    keys = [(r.randint(-5, 5), r.randint(0, 1), r.randint(0, 3), r.randint(0, 9), i) for i in range(4000)] + [(0, 0, 0, 0, 9000 + i) for i in range(2000)]
    df = spark.createDataFrame(keys, "low long, none long, id long, h long, row long").repartition(13).cache()
    for k in (1, 17, 2500, 5999, 6000):
        assert tuple(R.cutoff(df, k, few=2)) == sorted(keys)[k - 1]
    assert R.cutoff(df, 0) is None and R.cutoff(df, 6001) is None
    df.unpersist()


def test_weighted_median_leaves_a_quarter_on_either_side():
    r = random.Random(2)
    for _ in range(200):
        parts = [sorted(r.random() for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 12))]
        m = R._weighted_median([([p[(len(p) - 1) // 2]], len(p)) for p in parts])[0]
        n = sum(map(len, parts))
        assert sum(x <= m for p in parts for x in p) * 4 >= n and sum(x >= m for p in parts for x in p) * 4 >= n


def test_resampled_rows(spark):
    rows, target = fixture()
    docs = spark.createDataFrame([(i, t, "l", "s", 1, "r") for i, t in rows], SCHEMA)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (5, 40, 70):
        out = R.resampled(docs, bench, percent=percent)
        drawn = Counter(r.doc_id for r in R.draw(R.scored(docs, bench), percent=percent).where("rank IS NOT NULL").collect())
        assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == drawn


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([("a b",)], "text string")
    assert R.importance_resampling(none, bench).count() == 0 and R.resampled(none, bench).count() == 0
    one = spark.createDataFrame([(1, "w " * 30, "", "", 0, "")], SCHEMA)
    assert R.importance_resampling(one, bench.where("false"), percent=100).first().rank == 1
    long = spark.createDataFrame([(1, "ab " * 1_500_000, "", "", 0, ""), (2, "q" * 3_000_000, "", "", 0, "")], SCHEMA)
    got = {r.doc_id: r.n_features for r in R.importance_resampling(long, bench).collect()}
    assert got == {1: 3 * 1_500_000 - 3, 2: 1}
    assert np.array_equal(R.gains(np.zeros(10_000, int), np.zeros(10_000, int)), np.zeros(10_000, int))
