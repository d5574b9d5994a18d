"""Each stage of the pipeline against a plain version, on the smallest tables with cases planted."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataq.llm.jaccard_join import components
from strataq.llm.runtime import materialize
from strataq.llm.tokens import Encoder
from tests.llm.test_documents import brute_windows, gram_set, tokenizer, words

SF = "/root/testdata/sf0.001"
LEAST = -(2**63)


@pytest.fixture(scope="module")
def planted(spark):
    """The documents with near copies, a passage in common, a benchmark item, texts without letters, nulls and repeated rows."""
    real = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(4)
    english = [r for r in real.orderBy("doc_id").collect() if r.text and r.lang == "en" and len(words(r.text)) > 60]
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text), key=len)
    passage = " ".join(f"term{rng.randint(0, 900)}" for _ in range(60))
    edited = words(english[0].text)
    edited[len(edited) // 2] = "edited"
    texts = {
        10**6: english[0].text, 10**6 + 1: " ".join(edited), 10**6 + 2: f"{english[1].text}\n{passage}", 10**6 + 3: f"{passage}\n\n  {english[2].text}",
        10**6 + 4: f"{english[3].text} {item} {english[4].text}", 10**6 + 5: "\U0001f600\U0001f600 。 12", 10**6 + 6: "", 10**6 + 7: None,
    }
    like = english[5].asDict()
    rows = [{**like, "doc_id": i, "text": t} for i, t in texts.items()] + [{**like, "doc_id": None, "text": passage}, like]
    return real.unionByName(spark.createDataFrame([tuple(r[c] for c in real.columns) for r in rows], real.schema))


def key(r):
    return LEAST if r.doc_id is None else r.doc_id


def identified(before, after):
    """Rows stay as they are; nothing that has no letter stays, and next to nothing else goes."""
    left = Counter(before)
    left.subtract(Counter(after))
    assert min(left.values()) >= 0
    assert all(any(c.isalpha() for c in r.text or "") for r in after)
    gone = [r for r in (+left).elements() if any(c.isalpha() for c in r.text or "")]
    assert len(gone) <= 0.02 * len(before), [r.doc_id for r in gone]


def one_of_each(before, after):
    sets = {r: gram_set(r.text) for r in before}
    near = {s: [z for z in set(sets.values()) if len(s & z) >= 0.8 * len(s | z)] for s in sets.values() if s}
    want, seen = set(), set()
    # the least row of a class comes first: none sorts last
    for r in sorted((r for r in sets if sets[r]), key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        if sets[r] in seen:
            continue
        todo = [sets[r]]
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += near[s]
        want.add((r.doc_id, r.text))
    want |= {(r.doc_id, r.text) for r in sets if not sets[r]}
    assert Counter((r.doc_id, r.text) for r in after) == Counter(want)


def without_repeats(before, after):
    first = {}
    for r in sorted(before, key=key):
        w = words(r.text)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), key(r))
    want = Counter()
    for r in before:
        w = words(r.text)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < key(r):
                gone[k : k + 13] = [True] * 13
        if not w or not all(gone):
            want[r.doc_id, tuple(x for x, g in zip(w, gone, strict=True) if not g)] += 1
        if not any(gone):
            assert any(a.doc_id == r.doc_id and a.text == r.text for a in after)
    assert Counter((r.doc_id, tuple(words(r.text))) for r in after) == want


def clean(spark):
    import re

    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [(i, norm(r.text)) for i, r in enumerate(spark.read.parquet(f"{SF}/benchmark.parquet").collect())]
    items = [(i, x) for i, x in items if len(x) >= 5]
    shingles = defaultdict(list)
    for i, x in items:
        for g in {tuple(x[k : k + 5]) for k in range(len(x) - 4)}:
            shingles[g].append((i, x))

    def compare(before, after):
        want = Counter()
        for r in before:
            w = norm(r.text)
            near = {i: x for k in range(len(w) - 4) for i, x in shingles.get(tuple(w[k : k + 5]), ())}
            want[r] += not brute_windows([(0, w)], list(near.items()))
        assert Counter(after) == +want

    return compare


def packed(before, after):
    e = Encoder(tokenizer())
    assert max(Counter({s: sum(r.length for r in after if r.sequence_id == s) for s in {r.sequence_id for r in after}}).values()) <= 1024
    pieces = defaultdict(list)
    for r in after:
        pieces[r.doc_id].append(r)
    assert len({r.doc_id for r in before}) == len(before) == len(pieces)
    for r in before:
        ids, at = [*e.encode(r.text or "").tolist(), 0], 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)


def test_stages_against_plain_versions(spark, planted):
    import corpus_pipeline

    plain = {"language_id": identified, "jaccard_join": one_of_each, "substring_dedup": without_repeats, "decontamination": clean(spark), "packing": packed}
    docs, ids = materialize(planted), {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF))
        before, after = docs.collect(), out.collect()
        plain[name](before, after)
        ids[name] = {r.doc_id for r in after}
        docs = out
    assert not {10**6 + 5, 10**6 + 6, 10**6 + 7} & ids["language_id"]
    assert not {10**6, 10**6 + 1} & ids["jaccard_join"]
    assert 10**6 + 4 not in ids["decontamination"]


def test_stages_of_empty_tables(spark, planted):
    import corpus_pipeline

    docs = planted.where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
        assert docs.count() == 0, name


def test_components_without_broadcasts(spark):
    """A chain, a star and a ring; the rounds hold no table in the driver's memory."""
    edges = [(i, i + 1) for i in range(9)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)]
    plans = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    before = plans().size()
    got = {(r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(10)} | {(100 + i, 100) for i in range(40)} | {(200 + i, 200) for i in range(7)}
    new = [plans().apply(i).physicalPlanDescription() for i in range(before, plans().size())]
    assert any("SortMergeJoin" in p for p in new) and not any("BroadcastExchange" in p for p in new)
