"""Operators over documents against brute force on small fixtures with nulls, repeats, ties and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.llm import decontaminate, edit_counts, jaccard_join, language_id, packing, quality_rules, substring_dedup
from strataq.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, node string, bucket string"
WORD = r"[^\x20\x09-\x0D]+"


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(60)] + ["a", "a", "a", "the"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))) for _ in range(24)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    out = base + base[:4] + [b + " " + passage + "\n" + base[3] for b in base[4:9]] + [passage, "a " * 40, "a " * 31, "!!! " * 20, "", None, "  \n ", "x", "x"]
    near = [rng.choice(vocabulary) for _ in range(110)]
    for k in range(8):
        v = list(near)
        v[(k * 13) % len(v)] = f"edit{k % 5}"
        out.append(" ".join(v))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", 0, 7, "n", "b") for i, t in enumerate(texts())]
    rows += [rows[3], (None, "no id " * 20, None, None, None, None, None, None), (5, "another text of the same id", None, None, 1, 1, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(WORD, t or "")


def test_substring_dedup(spark, docs):
    for width in (13, 5):
        rows = sorted(((r.doc_id if r.doc_id is not None else -(2**63)), words(r.text)) for r in docs.collect())
        first = {}
        for i, w in rows:
            for k in range(len(w) - width + 1):
                first.setdefault(tuple(w[k : k + width]), i)
        want = Counter()
        for i, w in rows:
            gone = [False] * len(w)
            for k in range(len(w) - width + 1):
                if first[tuple(w[k : k + width])] < i:
                    gone[k : k + width] = [True] * width
            kept = " ".join(x for x, g in zip(w, gone) if not g)
            want[(None if i == -(2**63) else i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
        got = substring_dedup.substring_dedup(docs, width=width)
        assert Counter(tuple(r) for r in got.collect()) == want
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0
    out = substring_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.where("doc_id = 0").count() == 1


def test_substring_dedup_leaves_the_rest_of_a_text_alone(spark):
    copy = " ".join(f"c{i}" for i in range(15))
    clean = "  def f(x):\n\treturn  é \u3000 x\n\n\n# end \n"
    rows = [(1, copy, 7), (2, clean, 9), (3, f"\n  two  é\n{copy.replace(' ', chr(10))}\t\n  more\r\n x ", 0), (4, None, 0), (5, " \n ", 3), (6, f"a\n{copy} {copy}\n\nb  c\n{copy}", 0), (7, f" {copy}\n", 0)]
    out = {r.doc_id: (r.text, r.n_chars) for r in substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, n_chars int")).collect()}
    left3, left6 = "\n  two  é\n\t\n  more\r\n x ", "a\n\n\nb  c\n"
    assert out == {1: (copy, 7), 2: (clean, 9), 3: (left3, len(left3)), 4: (None, 0), 5: (" \n ", 3), 6: (left6, len(left6))}


def test_substring_dedup_of_hot_and_long_texts(spark):
    """A passage in every document, documents without id, one long text."""
    rng = random.Random(13)
    hot = " ".join(f"h{i}" for i in range(60))
    rows = [(None if i % 3 == 0 else i, " ".join(f"u{i}x{j}" for j in range(20)) + " " + hot) for i in range(1, 300)]
    rows.append((1000, " ".join(f"l{rng.randrange(10**6)}" for _ in range(100_000)) + " " + hot))
    got = Counter((r.doc_id is None, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(True, 80, 0): 99, (False, 80, 60): 200, (False, 100_060, 60): 1}


def test_cores_are_the_same_in_any_context():
    rng = np.random.default_rng(3)
    names = rng.integers(0, 6, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    from strataq.llm.words import rolling

    key = substring_dedup.cores(names, np.array([0, 1500, 4000]), 13)
    seen = {}
    windows = rolling(names, 13)
    copy = np.concatenate([names[:700], names[100:160], names[900:]])
    more = substring_dedup.cores(copy, np.array([0, len(copy)]), 13)
    for i in range(100, 160 - 13):
        assert key[i] == more[700 + i - 100]
    for i in [*range(1488), *range(1500, 3988)]:
        assert seen.setdefault(int(windows[i]), int(key[i])) == int(key[i])


def gram_set(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("small, chunk", [(16, 200), (1, 3)])
def test_jaccard_join(spark, docs, monkeypatch, small, chunk):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    rows = [(r.doc_id, gram_set(r.text)) for r in docs.collect()]
    sets = {s for _, s in rows if s}
    near = {s: {z for z in sets if z != s and len(s & z) >= 0.8 * len(s | z)} for s in sets}
    ids = defaultdict(list)
    for i, s in rows:
        ids[s].append(-(2**63) if i is None else i)
    want = Counter()
    for i, s in rows:
        if not s:
            want[(i, i, 0)] += 1
            continue
        group, todo = {s}, [s]
        while todo:
            for z in near[todo.pop()] - group:
                group.add(z)
                todo.append(z)
        least = min(min(ids[z]) for z in group)
        want[(i, None if least == -(2**63) else least, len(near[s]))] += 1
    assert Counter(tuple(r) for r in jaccard_join.jaccard_join(docs).collect()) == want
    assert any(k[2] for k in want)


def test_components_without_counts(spark, docs, monkeypatch):
    """Pivots leave out comparisons, never links: chains that no pivot spans, copies of one text, and the fixture."""
    monkeypatch.setattr(jaccard_join, "SMALL", 1)
    monkeypatch.setattr(jaccard_join, "CHUNK", 3)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 1)
    chain = [(1000 + k, " ".join(f"c{i}" for i in range(4 * k, 4 * k + 64))) for k in range(25)]
    star = [(2000 + k, " ".join(f"s{k}" if i == k else f"s_{i}" for i in range(90))) for k in range(40)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(chain + star, "doc_id long, text string"))
    full, less = jaccard_join.Join(d), jaccard_join.Join(d, counts=False)
    assert Counter(map(tuple, less.survivors.collect())) == Counter(map(tuple, full.survivors.collect()))
    assert {r.class_id for r in full.membership.where("doc_id >= 1000").collect()} == {1000, 2000}
    with pytest.raises(ValueError):
        less.membership


def test_a_group_of_near_copies_has_no_tiles_without_counts(spark):
    rows = [(k, " ".join(f"s{k}" if i == k % 90 else f"s_{i}" for i in range(90))) for k in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    less = jaccard_join.Join(d, counts=False)
    assert less.tiles.count() == 0 and [r.doc_id for r in less.survivors.collect()] == [0]
    assert jaccard_join.Join(d).tiles.count() > 0


def test_jaccard_edges(spark, docs):
    assert jaccard_join.jaccard_join(empty(spark)).count() == 0
    bands, rows = jaccard_join.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 24").count() == 0 and kept.where("doc_id = 0").count() == 1 and kept.where("doc_id = 5").count() == 2


def test_rows_without_id_ship_one_text_a_class(spark):
    """2,000 rows that share an id (or have none) in near pairs: one text for each class goes to its pairs."""
    base = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    rows = [(None if k % 2 else 5, base(k)) for k in range(500)] + [(None if k % 2 else 5, base(k) + " more") for k in range(500)] + [(None, base(1))] * 1000
    join = jaccard_join.Join(spark.createDataFrame(rows, "doc_id long, text string"))
    nodes = join.nodes.select("node")
    shipped = join._texts_of(nodes)
    assert nodes.count() == 1000 and shipped.count() == 1000
    got = Counter((r.class_id, r.n_links) for r in join.membership.collect())
    assert got[(5, 1)] == 500 and got[(None, 1)] == 1500


def test_keep_one_knows_rows_by_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a, 1), (5, b, 2), (None, c, 3), (None, c, 4), (None, a, 5), (None, None, 6), (7, "", 7), (8, " ", 8), (9, a + " end", 9), (6, b, 10), (5, b, 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, node int")
    kept = jaccard_join.keep_one(d)
    assert kept.columns == d.columns
    got = sorted(r.node for r in kept.collect())
    assert got in ([1, 2, 3, 6, 7, 8], [1, 2, 4, 6, 7, 8])
    assert jaccard_join.keep_one(d.where("false")).count() == 0


def test_jaccard_join_of_long_texts(spark):
    rng = random.Random(12)
    w = [f"w{rng.randrange(4000)}" for _ in range(60_000)]
    rows = [(3, " ".join(w)), (1, " ".join(w[:55_000])), (2, " ".join(w[:30_000])), (9, " ".join(w[:59_999]) + " x")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: (1, 2), 1: (1, 2), 2: (2, 0), 9: (1, 2)}


def test_bands_find_pairs_at_the_threshold(spark):
    """Measured, not worked out: pairs of sets at 0.8 to 0.82 that share a bucket."""
    rng, rows = random.Random(15), []
    for k in range(600):
        w = [f"{k}x{i}" for i in range(90)]
        v = list(w)
        for j in range(9):  # runs of five words at one place each: 9 of 86 left out at the end
            v[len(v) - 1 - j] = f"{k}y{j}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    sets = [gram_set(t) for _, t in rows[:2]]
    assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.82
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links = 1").count()
    assert got >= 0.99 * len(rows)


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, texts()[30][:200]), (2, None), (3, "one two"), (4, " ".join(words(texts()[12])[5:40]).upper()), (5, "w1 w2 w3 w4 w5 w6 w7")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, round(r.similarity, 6)) for r in decontaminate.contaminated(docs, bench).collect()}
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = {}
    for r in docs.collect():
        for b in bench.collect():
            w, x = norm(r.text), norm(b.text)
            if len(x) < 5 or len(w) < 5:
                continue
            g = lambda y: Counter(tuple(y[i : i + 5]) for i in range(len(y) - 4))
            for s in range(max(1, len(w) - len(x) + 1)):
                c, d = g(w[s : s + len(x)]), g(x)
                sim = sum((c & d).values()) / sum((c | d).values())
                if sim >= 0.8 and sim > want.get((r.doc_id, b.item_id), (0, 0))[1]:
                    want[r.doc_id, b.item_id] = (s, round(sim, 6))
    assert want and got == want
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} & {k[0] for k in want} <= {5}


def test_decontamination_knows_rows_by_text(spark):
    item = " ".join(f"q{i}" for i in range(30))
    rows = [(None, item, 1), (None, "clean text of no id at all", 2), (5, item, 3), (5, "another clean text of the same id", 4), (6, f"x {item} y", 5), (6, f"x {item} y", 6), (7, None, 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, h int")
    bench = spark.createDataFrame([(None, item), (1, item), (1, item)], "item_id long, text string")
    got = Counter(tuple(r) for r in decontaminate.contaminated(d, bench).collect())
    assert got == Counter((i, b, s, 1.0) for i, s in ((None, 0), (5, 0), (6, 1)) for b in (None, 1))
    left = decontaminate.drop_contaminated(d, bench)
    assert left.columns == d.columns and sorted(r.h for r in left.collect()) == [2, 4, 7]


def brute_windows(docs, items, threshold=0.8):
    """(doc, item): (start, similarity) of the best of all windows."""
    out = {}
    grams = lambda y: [tuple(y[k : k + 5]) for k in range(len(y) - 4)]
    for i, w in docs:
        g = grams(w)
        for j, x in items:
            c = Counter(grams(x))
            m = len(x) - 4
            for s in range(max(1, len(g) - m + 1)):
                d = Counter(g[s : s + m])
                both = sum((c & d).values())
                sim = both / (c.total() + d.total() - both)
                if sim >= threshold - 1e-9 and sim > out.get((i, j), (0, 0))[1]:
                    out[i, j] = (s, sim)
    return out


def test_decontaminated_tables_may_have_any_columns(spark):
    item = " ".join(f"b{i}" for i in range(30))
    names = "doc_id long, text string, _doc long, _h long, row string, _id long, _text string, h string, `a.b` int"
    d = spark.createDataFrame([(1, f"so {item} so", 1, 2, "r", 3, "t", "h", 4), (2, "clean text", 1, 2, "r", 3, "t", "h", 4), (None, item, 1, 2, "r", 3, "t", "h", 4)], names)
    out = decontaminate.drop_contaminated(d, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert out.columns == d.columns and [r.doc_id for r in out.collect()] == [2]


def test_decontamination_finds_what_all_windows_hold(spark):
    """Swapped halves, moved and edited items, at and around the threshold, inside other text."""
    rng = random.Random(11)
    word = lambda: f"v{rng.randint(0, 3000)}"
    items = [(j, [word() for _ in range(rng.randint(20, 60))]) for j in range(40)]
    items[0] = (0, [f"s{i}" for i in range(60)])
    docs = []
    for j, x in items:
        for k in range(6):
            y, n = list(x), len(x)
            if k == 0:
                y = y[n // 2 :] + y[: n // 2]
            elif k == 1:
                y[rng.randrange(n)] = word()
            elif k == 2:
                y = y[: n - (n - 4) // 9]
            elif k == 3:
                y = y[(n - 4) // 9 :]
            elif k == 4:
                y[0], y[-1] = word(), word()
            docs.append((10 * j + k, [word() for _ in range(rng.choice([0, 3, 17, 150]))] + y + [word() for _ in range(rng.choice([0, 2, 90]))]))
    want = brute_windows(docs, items)
    assert want[0, 0][1] == 52 / 60
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    b = spark.createDataFrame([(j, " ".join(x)) for j, x in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontaminate.contaminated(d, b).collect()}
    assert all(want.get(k) == pytest.approx(v) for k, v in got.items())
    assert (0, 0) in got and len(got) >= 0.97 * len(want) and len(want) > 150


def test_decontamination_of_long_texts(spark):
    rng = random.Random(3)
    item = [f"z{rng.randint(0, 90)}" for _ in range(50)]
    long = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(20_000)]
    long[11_234:11_284] = item
    book = [f"b{i % 977}" for i in range(4_000)]
    d = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(book)), (3, "")], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(book))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.start for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(1, 1): 11_234, (2, 2): 0}


def test_decontamination_of_documents_shorter_than_an_item(spark):
    rng = random.Random(7)
    items = [[f"x{rng.randint(0, 400)}" for _ in range(50)] for _ in range(60)]
    rows = [(100 * i + k, " ".join(w[:k] if i % 2 else w[50 - k :])) for i, w in enumerate(items) for k in (40, 41, 42, 44, 49, 50)]
    rows.append((142, " ".join(items[1] + items[3][:9])))  # a longer row of the same id
    d = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, round(r.similarity, 6)) for r in decontaminate.contaminated(d, bench).collect()}
    want = {}
    for i, text in rows:
        w, x = text.split(), items[i // 100]
        c, g = (Counter(tuple(y[k : k + 5]) for k in range(len(y) - 4)) for y in (w[:50], x))
        sim = sum((c & g).values()) / sum((c | g).values())
        if sim >= 0.8 and sim > want.get((i, i // 100), (0, 0))[1]:
            want[i, i // 100] = (0, round(sim, 6))
    assert got == want and {k[0] % 100 for k in got} == {41, 42, 44, 49, 50}
    assert decontaminate.drop_contaminated(d, bench).count() == len(items)


def test_hamming_blocks_find_all_within_radius(spark):
    assert sum(e + 1 for _, _, e in decontaminate.BLOCKS) == decontaminate.RADIUS + 1 and sum(w for _, w, _ in decontaminate.BLOCKS) == 64
    rng = random.Random(1)
    a = [rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    b = [x ^ sum((1 << i) if i < 63 else -(1 << 63) for i in rng.sample(range(64), decontaminate.RADIUS)) for x in a]
    df = spark.createDataFrame(list(zip(a, b)), "a long, b long")
    hit = df.select(F.size(F.array_intersect(decontaminate.lookups(F.lit(7), F.col("a")), decontaminate.entries(F.lit(7), F.col("b")))).alias("n"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("d"))
    assert all(r.n > 0 and r.d == decontaminate.RADIUS for r in hit.collect())


def test_simhash_counts_bits(spark):
    rng = random.Random(2)
    rows = [([rng.getrandbits(64) - (1 << 63) for _ in range(n)],) for n in (1, 2, 3, 40, 301)]
    want = []
    for (g,) in rows:
        bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in g) > len(g))
        want.append(bits - (1 << 64) if bits >> 63 else bits)
    df = spark.createDataFrame(rows, "g array<long>")
    for lane in (16, 32):
        assert [r.f for r in df.select(decontaminate.simhash(F.col("g"), lane).alias("f")).collect()] == want


def test_quality_counts(spark, docs):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.quality_rules(docs).collect()}
    for r in docs.collect():
        w, t = words(r.text), r.text or ""
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(tri)
        cover = {i + j for i, x in enumerate(tri) if c[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        x = got[r.doc_id, len(w)]
        assert (x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(cover))
        assert x.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (x.base_failed and x.kept)
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def test_sketch_merges_and_bounds_quantiles(spark):
    m = spark.range(3000).select(F.lit("en").alias("lang"), F.lit("s").alias("source"), *(F.col("id").alias(x) for x in quality_rules.METRICS))
    parts = [quality_rules.sketches(m.where(f"id % 3 = {k}")) for k in range(3)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "source", "metric", "bin").agg(F.sum("n").alias("n"))
    whole = quality_rules.sketches(m)
    assert Counter(map(tuple, merged.collect())) == Counter(map(tuple, whole.collect()))
    assert whole.where("metric = 'symbol_ppm'").count() < 300


def fence_table(values, min_group):
    """Fences worked out from sorted values: {(lang, source): fence} of the first metric (tail 95 %)."""

    def low(x):
        shift = max(0, x.bit_length() - quality_rules.PRECISION)
        return x >> shift << shift

    def own(v):
        v = sorted(map(low, v))
        at = lambda percent: v[-(-len(v) * percent // 100) - 1]
        return 2 * (at(95) + (1 << max(0, at(95).bit_length() - quality_rules.PRECISION)) - 1) - at(50)

    def within(v, parent):
        if len(v) < min_group:
            return parent
        return own(v) or None if parent is None else min(own(v) or parent, 2 * parent)

    everything = [x for v in values.values() for x in v]
    corpus = own(everything) or None
    out = {}
    for lang, source in values:
        whole = within([x for k, v in values.items() if k[0] == lang for x in v], corpus)
        out[lang, source] = within(values[lang, source], whole)
    return out


def test_fences_fall_back_to_parents(spark):
    rng = random.Random(8)
    values = {("en", "calm"): [rng.randint(0, 400) for _ in range(300)], ("en", "wild"): [rng.randint(200, 1500) for _ in range(300)], ("en", "few"): [9999] * 20, ("en", "junk"): [rng.choice([10, 90_000]) for _ in range(250)], ("fr", "zero"): [0] * 280, ("fr", None): [rng.randint(0, 900) for _ in range(240)], (None, "x"): [5] * 3}
    m = spark.createDataFrame([(k[0], k[1], x, 1, 1, 1) for k, v in values.items() for x in v], "lang string, source string, " + ", ".join(f"{x} long" for x in quality_rules.METRICS))
    got = {(r.lang, r.source): r.symbol_ppm_fence for r in quality_rules.fences(quality_rules.sketches(m)).collect()}
    want = fence_table(values, 200)
    assert got == want and got["en", "few"] == want["en", "few"] and got["en", "calm"] < got["en", "wild"]
    none = quality_rules.fences(quality_rules.sketches(m.withColumn("symbol_ppm", F.lit(0).cast("long")))).collect()
    assert {r.symbol_ppm_fence for r in none} == {None}


def test_the_sketch_decides_by_source(spark):
    """One text, two sources: the source where such texts are common keeps it, the other one drops it."""
    rng = random.Random(6)

    def text(symbols):
        w = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for i in rng.sample(range(120), symbols):
            w[i] = w[i][:-1] + "#"
        return " ".join(w)

    rows = [(i, text(rng.randint(0, 3) if i % 2 else rng.randint(2, 14)), "en", "plain" if i % 2 else "code") for i in range(800)]
    odd = text(16)
    rows += [(1000, odd, "en", "plain"), (1001, odd, "en", "code"), (1002, text(60), "en", "code"), (1003, odd, "en", "plain")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [got[i].kept for i in (1000, 1001, 1002, 1003)] == [False, True, False, False] and not got[1002].base_failed
    assert sum(not r.kept for i, r in got.items() if i < 1000) < 16
    # a table of copies of one text and a clean corpus lose nothing
    same = spark.createDataFrame([(i, odd, None, None) for i in range(300)], "doc_id long, text string, lang string, source string")
    assert {r.kept for r in quality_rules.quality_rules(same).collect()} == {True}


def test_quality_of_long_texts(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(120_000))
    d = spark.createDataFrame([(1, long, "en", "s"), (2, "x " * 200_000, "en", "s"), (3, "y" * 1_000_000, "en", "s")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(d).collect()}
    assert (got[1].n_words, got[1].kept, got[2].n_repeat_words, got[2].base_failed, got[3].word_chars) == (120_000, True, 200_000, True, 1_000_000)


def test_tokens_are_the_library_s():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    t.encode_special_tokens = True
    e = Encoder(tokenizer())
    for x in [*filter(None, texts()), "  two  spaces \n\n x", "tab\t x \r\n", "naïve 日本語 123,456 it's <|endoftext|>", " " * 50, "a" * 3000, "\n \n  z "]:
        assert e.encode(x).tolist() == t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 10**6, "\n" * 10**6, "x" + " " * 10**6 + "y", "a " + "\t\n" * 20_000 + "\u3000b", "\x1c" * 30_000, " " * 10_000, " " * 9_999 + "z", "q" * 10**6, "é" * 200_000, ("1 " + " " * 12_000) * 3, "  " + "\xa0" * 12_000 + "\n's"])
def test_tokens_of_long_runs(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    want = t.encode(text, add_special_tokens=False).ids
    for ordinary in (True, False):
        assert Encoder(tokenizer(), ordinary=ordinary).ids(text) == want


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    file = json.load(open(tokenizer(), encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": file["model"] | {"merges": file["model"]["merges"][::-1]}}, {"model": file["model"] | {"unk_token": "x"}}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps(file | change), encoding="utf-8")
        with pytest.raises(ValueError):
            Encoder(str(path))


def test_long_blanks_are_packed_and_counted(spark):
    d = spark.createDataFrame([(1, " " * 10**6), (2, "\n" * 300_000 + "x"), (3, "y")], "doc_id long, text string")
    tokens = {r.doc_id: r.doc_tokens for r in packing.pack(d, tokenizer=tokenizer()).select("doc_id", "doc_tokens").distinct().collect()}
    trees = edit_counts.token_trees(edit_counts.derived_edits(d), tokenizer=tokenizer())
    counts = {r.doc_id: r.n_tokens for r in edit_counts.apply_edits(trees, tokenizer=tokenizer()).collect()}
    assert tokens == {i: n + 1 for i, n in counts.items()} and tokens[1] == 10**6 + 1


END = "<|endoftext|>"


def test_added_tokens_have_their_own_ids(spark):
    import zlib

    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(tokenizer()), Encoder(tokenizer(), ordinary=False)
    odd = [END, f"a {END} b", f"x  \n  {END}{END}  y", f"<|endoftext{END}|>", f"one{END[:7]} {END[7:]}", "plain text", f" {END}"]
    for x in odd:
        assert e.encode(x).tolist() == t.encode(x, add_special_tokens=False).ids
    d = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r.doc_id: r for r in packing.pack(d, tokenizer=tokenizer()).collect()}
    for i, x in enumerate(odd):
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        assert (got[i].doc_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_edits_that_make_and_break_added_tokens():
    from tokenizers import Tokenizer

    rng, t, e = random.Random(4), Tokenizer.from_file(tokenizer()), Encoder(tokenizer(), ordinary=False)
    parts = ["w", " w", "  ", "\n", f" {END}", f"  {END}", END, END[:6], END[6:], f" {END[:6]}", "  <"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(40))
        cut = edit_counts.leaves(text, 4, edit_counts.safe_start(e.added))
        assert "".join(cut) == text
        tree = edit_counts.Tree(list(cut), [e.count(x) for x in cut])
        assert tree.tokens == len(t.encode(text, add_special_tokens=False).ids)
        for _ in range(12):
            s, n, x = rng.randint(0, len(text)), rng.choice([0, 0, 1, 2, 9, 30]), rng.choice(["", *parts])
            tree.edit(s, n, x, e)
            text = text[:s] + x + text[s + n :]
            assert tree.tokens == len(t.encode(text, add_special_tokens=False).ids)


def test_edit_counts(spark, docs):
    rng = random.Random(9)
    e = Encoder(tokenizer())
    log, want = [], {}
    d = docs.where("doc_id < 40").dropDuplicates(["doc_id"])
    rows = [(r.doc_id, (r.text or "") * 9) for r in d.collect()]
    for i, t in rows:
        before = len(e.encode(t))
        for k in range(5):
            s, n, x = rng.randint(-2, len(t) + 3), rng.randint(0, 30), rng.choice(["", " ", "  ", "x", " new words\n", "\t"])
            log.append((i, k, s, n, x))
            s = min(max(s, 0), len(t))
            t = t[:s] + x + t[min(len(t), s + n) :]
        want[i] = (before, len(e.encode(t)), len(t))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    edits = spark.createDataFrame(log, "doc_id long, seq long, start long, n_delete long, insert string")
    got = edit_counts.apply_edits(edit_counts.token_trees(edit_counts.with_edits(frame, edits), tokenizer=tokenizer()), tokenizer=tokenizer())
    assert {r.doc_id: (r.n_tokens, r.n_tokens_after, r.n_chars_after) for r in got.collect()} == want
    none = edit_counts.derived_edits(empty(spark))
    assert edit_counts.apply_edits(edit_counts.token_trees(none, tokenizer=tokenizer()), tokenizer=tokenizer()).count() == 0


def test_edited_trees_go_on(spark):
    """Batch after batch on written trees: counts are those of the whole text, leaves stay short."""
    rng, e = random.Random(12), Encoder(tokenizer(), ordinary=False)
    texts_ = {1: "some words of a text " * 200, 2: "", 3: "x" * 3000, None: "no id at all " * 90}
    trees = edit_counts.token_trees(spark.createDataFrame(list(texts_.items()), "doc_id long, text string"), tokenizer=tokenizer())
    for _ in range(3):
        log = []
        for i, t in texts_.items():
            for k in range(6):
                s, n, x = rng.randint(0, len(t)), rng.randint(0, 40), rng.choice(["", " added words here" * 60, END, " "])
                log.append((i, k, s, n, x))
                t = t[:s] + x + t[s + n :]
            texts_[i] = t
        edits = spark.createDataFrame(log, "doc_id long, seq long, start long, n_delete long, insert string")
        trees = spark.createDataFrame(edit_counts.edited_trees(edit_counts.with_edits(trees, edits), tokenizer=tokenizer()).collect(), "doc_id long, text string, leaf_chars array<long>, leaf_tokens array<long>")
        for r in trees.collect():
            t = texts_[r.doc_id]
            assert (r.text, sum(r.leaf_chars), sum(r.leaf_tokens)) == (t, len(t), e.count(t))
            at = 0
            for n, k in zip(r.leaf_chars, r.leaf_tokens):
                assert e.count(t[at : at + n]) == k
                at += n
            if " " in t:
                assert max(r.leaf_chars) <= max(2 * edit_counts.LEAF, max(map(len, t.split(" "))) + edit_counts.LEAF + 2)


def test_packing(spark, docs):
    import zlib

    e = Encoder(tokenizer())
    for window in (1024, 64):
        got = packing.pack(docs, tokenizer=tokenizer(), window=window).collect()
        by = defaultdict(list)
        for r in got:
            by[r.sequence_id].append((r.offset, r.length))
        for parts in by.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= window
        pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got)
        for r in docs.collect():
            ids = [*e.encode(r.text or "").tolist(), 0]
            at = 0
            while at < len(ids):
                fit = [p for p in pieces if p[0] == r.doc_id and p[1] == at and p[4] == len(ids) and p[3] == zlib.crc32(np.array(ids[at : at + p[2]], "<u4").tobytes()) and pieces[p]]
                assert fit
                pieces[fit[0]] -= 1
                at += fit[0][2]
        assert not +pieces
    assert packing.pack(empty(spark), tokenizer=tokenizer()).count() == 0


def test_least_squares_fills_windows():
    h = np.zeros(64, np.int64)
    h[[20, 44, 30, 34, 32]] = [500, 450, 70, 90, 10]
    slots, rest, n = packing.plan(h, 64)
    assert n >= 450 + 70 and sum(hi - lo for v in slots.values() for lo, hi, _, _ in v) >= 900


def test_symbols_beyond_the_low_planes_are_no_letters(spark):
    for x in ["\U0001f600", "\uff11\uff12", "\u3002\u300c\u300d\u3000", "\U0001f600\ufe0f\uff01 12", "\U0001d7d8"]:
        assert not len(language_id.features(x)[0]), x
    for a, b in [("日本\U0001f600語", "日本。語"), ("ab\uff0ccd", "ab cd"), ("\uff21\U00010400", "\uff41\U00010428")]:
        assert [v.tolist() for v in language_id.features(a)] == [v.tolist() for v in language_id.features(b)]
    assert len(language_id.features("日")[0]) and len(language_id.features("\U00020000")[0])
    rows = [(i, "und der die", "de") for i in range(8)] + [(90, "\U0001f600 \uff11 \u3002", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(d).collect()}
    assert got[90] == ("und", 0.0) and got[0][0] == "de"


def test_language_sample_is_bounded(spark):
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the and of to").alias("text"), F.lit("en").alias("lang"))
    more = spark.range(200).select("id", F.concat(F.lit("der die und das "), "id").alias("text"), F.concat(F.lit("l"), F.col("id") % 7).alias("lang")).toDF("doc_id", "text", "lang")
    rows = []
    fit = language_id.ftrl
    language_id.ftrl = lambda model, r, **k: (rows.extend(r), fit(model, r, **k))
    try:
        model = language_id.train(same.unionByName(more), per_language=50, max_languages=3)
    finally:
        language_id.ftrl = fit
    assert model.languages[0] == "en" and len(model.languages) == 3 and sum(model.languages[y] == "en" for y, _, _ in rows) <= 1


def test_what_the_driver_receives_is_bounded(spark, monkeypatch):
    r = random.Random(3)
    d = spark.createDataFrame([(i, "".join(chr(97 + r.randrange(26)) for _ in range(4000)), f"l{i % 5}") for i in range(200)], "doc_id long, text string, lang string")
    rows = []
    fit = language_id.ftrl
    monkeypatch.setattr(language_id, "ftrl", lambda model, x, **k: (rows.extend(x), fit(model, x, **k)))
    language_id.train(d, per_language=1000, max_texts=50)
    assert 20 <= len(rows) <= 70 and max(len(i) for _, i, _ in rows) == language_id.PER_TEXT


def plain_features(text):
    """Blank-separated lower-case letters and their runs of one to three, with counts: no hashing."""
    kept = " " + re.sub(" +", " ", "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)) + " "
    kept = re.sub("^  +| (?= $)", " ", kept)
    return Counter(kept[i : i + k] for k in (1, 2, 3) for i in range(len(kept) - k + 1))


def test_prediction_is_the_softmax_of_tf_idf(spark):
    """Scores of a model held to a plain sum over n-grams, document frequencies to a plain count."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    model = language_id.train(d, per_language=100)
    rows = d.select("text", "lang", language_id.held_out().alias("held")).collect()
    index = {}

    def slot(gram):
        if gram not in index:  # a gram's place: that which its text has and a text without it has not
            index[gram] = frozenset(language_id.features(gram)[0].tolist())
        return index[gram]

    df = Counter()
    for r in rows:
        if not r.held and r.lang is not None:
            df.update(language_id.features(r.text)[0].tolist())
    n = sum(not r.held and r.lang is not None for r in rows)
    idf = np.log((1 + n) / (1 + np.array([df[i] for i in range(language_id.SIZE)]))) + 1
    assert np.allclose(model.idf, idf)
    for r in rows[:20]:
        i, c = language_id.features(r.text)
        assert c.sum() == plain_features(r.text).total()
        x = [(1 + np.log(k)) * idf[j] for j, k in zip(i, c)]
        x = np.array(x) / np.sqrt(np.dot(x, x))
        z = np.array([sum(v * model.weights[j, k] for j, v in zip(i, x)) + model.bias[k] for k in range(len(model.languages))]) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        lang, score = model.predict(r.text)
        assert lang == model.languages[int(p.argmax())] and score == pytest.approx(p.max())


def test_language_of_long_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = d.where("lang = 'de'").agg(F.array_join(F.collect_list("text"), " ").alias("t")).first().t * 12
    odd = d.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10_000, long, None), (10_001, "1 2 " * 300_000, None)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r.lang_pred for r in language_id.identify(odd).where("doc_id >= 10000").collect()}
    assert got == {10_000: "de", 10_001: "und"}


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, "123 !!"), (None, "und der die"), (4, "")], "doc_id long, text string").withColumn("lang", F.lit("de"))
    rows = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(odd).collect()}
    assert rows[1] == rows[2] == rows[4] == ("und", 0.0)
    assert language_id.identify(empty(spark)).count() == 0
    kept = language_id.keep_identified(d.withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("x")))
    assert kept.columns == [*d.columns, "lang_pred", "score"] and kept.count() == d.count()
