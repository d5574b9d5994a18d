"""N-gram Jaccard join by MinHash banding.

A text is the set of its runs of ``n`` words (a shorter text is one run of all its words). Texts with equal sets form a
text class, and only classes are compared. Band and row counts are chosen for ``recall`` at ``threshold``; classes
shuffle on the hashes of their bands and meet in buckets. All pairs that share a bucket are verified on the full sets:

* of buckets up to ``SMALL`` classes as a list of distinct pairs;
* in larger buckets in tiles. Classes of large buckets are dealt into chunks of about ``CHUNK``, a tile is two chunks
  that share a bucket, and one task compares a tile's sets by blocks of a matrix product. It returns only the edges that
  connect its classes and the number of links of each class, never all pairs.

Result: one row for each document with its class (the smallest doc_id of its connected component) and the number of
other text classes that are as similar.

Edge cases: texts that are null or without words are in no class but their own and have no links; equal rows are
copies; rows that share a doc_id with different texts are classed by text; null doc_id sorts before all others; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.runtime import materialize, small_batches
from strataq.llm.words import mix, named, rolling, slices

SMALL = 16
#: Classes, and runs of words, that a chunk holds about.
CHUNK, CHUNK_GRAMS = 200, 400_000
#: Distinct runs of words in a block of a tile's matrix.
COLUMNS = 4096
#: Classes of a large bucket that all its classes meet first.
PIVOTS = 8
_LOW = np.iinfo(np.int64).min


def bands_for(threshold: float, recall: float, rows: int = 6) -> tuple[int, int]:
    """(bands, rows): the fewest bands that find a pair of this similarity with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def grams(names: np.ndarray, n: int) -> np.ndarray:
    """The sorted set of a text's runs of ``n`` words."""
    return np.unique(rolling(names, n if len(names) >= n else max(1, len(names))))


def _texts(col: pa.Array, n: int) -> Iterator[np.ndarray]:
    for a, b, data, offs in slices(col):
        names, woff, _, _ = named(data, offs)
        for d in range(b - a):
            yield grams(names[woff[d] : woff[d + 1]], n)


def set_key(g: np.ndarray) -> int:
    """A hash of a set that doesn't depend on order."""
    if not len(g):
        return 0
    return int(mix(np.array([mix(g ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(g))], np.uint64)).view(np.int64)[0])


def _signatures(n: int, bands: int, rows: int):
    rng = np.random.default_rng(1234567)
    mul = (rng.integers(0, 2**31, size=(bands * rows, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
    salt = rng.integers(0, 2**63, size=(bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    kinds = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n_grams", pa.int64()), ("h", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, keys = [], [], []
            for g in _texts(b.column("text"), n):
                nodes.append(set_key(g)), sizes.append(len(g))
                if not len(g):
                    keys.append(None)
                    continue
                x = (g >> np.uint64(32)).astype(np.uint32)
                least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
                for i in range(0, len(x), 2048):
                    np.minimum(least, (mul * x[None, i : i + 2048]).min(1), out=least)
                k = (least.reshape(bands, rows).astype(np.uint64) * salt).sum(1) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                keys.append(mix(k).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), b.column("h"), pa.array(keys, pa.list_(pa.int64()))], schema=kinds)

    return run


def _similar(n: int):
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray | None] = (None, None)
        for batch in batches:
            out = []
            right = _texts(batch.column("text_b"), n)
            for a, b, text, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_a").to_pylist(), right, strict=True):
                if text != last[0]:
                    last = (text, next(_texts(pa.array([text]), n)))
                x = last[1]
                if set_key(x) == a and set_key(y) == b:  # else a row that shares the doc_id
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    out.append((a, b, both / max(1, len(x) + len(y) - both)))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, kinds, strict=True)], schema=kinds)

    return run


def _tile(n: int, threshold: float):
    """Compare two chunks (or one with itself): connecting edges (a, b) and link counts (a, n)."""

    def run(t: pa.Table) -> pa.Table:
        side, node = t.column("side").to_numpy(), t.column("node").to_numpy()
        sets = list(_texts(t.column("text"), n))
        real = np.array([set_key(g) == k for g, k in zip(sets, node, strict=True)], bool)
        order = np.flatnonzero(real)
        order = order[np.lexsort((node[order], side[order]))]
        if len(order):  # a row that shares the doc_id may repeat a class
            order = order[np.append(True, (node[order][1:] != node[order][:-1]) | (side[order][1:] != side[order][:-1]))]
        node, side, sets = node[order], side[order], [sets[i] for i in order]
        size = np.array([len(g) for g in sets], np.int64)
        m, left = len(sets), int((side == 0).sum())
        two = left < m
        lists: dict[str, list] = {"a": [], "b": [], "n": []}
        if m > 1:
            grams_ = np.concatenate(sets)
            who = np.repeat(np.arange(m), size)
            by = np.argsort(grams_, kind="stable")
            grams_, who = grams_[by], who[by]
            first = np.flatnonzero(np.append(True, grams_[1:] != grams_[:-1]))
            times = np.diff(np.append(first, len(grams_)))
            keep = np.repeat(times > 1, times)
            code = np.cumsum(np.repeat(times > 1, times) & np.isin(np.arange(len(grams_)), first)) - 1
            code, who = code[keep], who[keep]
            top = int(code[-1]) + 1 if len(code) else 0
            a, b = (slice(0, left), slice(left, m)) if two else (slice(0, m), slice(0, m))
            both = np.zeros((a.stop - a.start, b.stop - b.start), np.float32)
            for lo in range(0, top, COLUMNS):
                i, j = np.searchsorted(code, [lo, lo + COLUMNS])
                x = np.zeros((m, min(COLUMNS, top - lo)), np.float32)
                x[who[i:j], code[i:j] - lo] = 1
                both += x[a] @ x[b].T
            union = size[a][:, None] + size[b][None, :] - both
            hit = both >= threshold * union - 1e-6
            if not two:
                hit &= ~np.eye(m, dtype=bool)
            count = np.zeros(m, np.int64)
            count[a] += hit.sum(1)
            if two:
                count[b] += hit.sum(0)
            root = list(range(m))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i, j in zip(*(v.tolist() for v in np.nonzero(hit)), strict=True):
                j += b.start
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    lists["a"].append(int(node[i])), lists["b"].append(int(node[j])), lists["n"].append(None)
            for i in np.flatnonzero(count):
                lists["a"].append(int(node[i])), lists["b"].append(None), lists["n"].append(int(count[i]))
        return pa.table({k: pa.array(v, pa.int64()) for k, v in lists.items()})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): alternating large and small stars until nothing changes. Both sides
    of a join are dealt by node already; broadcasts would add a job, a thread and a table in the driver's memory to each."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        near = e.join(low.hint("merge"), "a")
        e = near.select("a", F.col("m").alias("b")).unionByName(near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        e = materialize(e)
        now = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = now


def _homes(large: DataFrame) -> DataFrame:
    """(node, n_grams, key): the bucket of each class of large buckets in which it is dealt into chunks. Classes gather
    under the largest bucket near them, so that chunks of a group fill up."""
    home = large.groupBy("node").agg(F.max(F.struct("of", "key")).alias("home"))
    near = large.select("key", "node").join(home, "node").groupBy("key").agg(F.max("home").alias("home"))
    home = large.select("key", "node", "n_grams").join(near, "key").groupBy("node").agg(F.max("home").alias("home"), F.first("n_grams").alias("n_grams"))
    return home.select("node", "n_grams", F.col("home.key").alias("key"), F.lit(False).alias("linked"))


def _chunks(home: DataFrame) -> DataFrame:
    """``home`` with the chunk of each class: (k, linked) name its group, p a part of the group."""
    of = home.groupBy("key", "linked").agg(F.count(F.lit(1)).alias("of"), F.sum("n_grams").alias("grams"))
    parts = F.ceil(F.greatest(F.col("of") / CHUNK, F.col("grams") / CHUNK_GRAMS)).cast("long")
    chunk = F.struct(F.col("key").alias("k"), "linked", F.pmod(F.xxhash64("node", F.lit(5)), parts).alias("p"))
    return home.join(of, ["key", "linked"]).select("node", "key", chunk.alias("chunk"))


def _tiles(large: DataFrame, chunks: DataFrame) -> DataFrame:
    """(left, right): chunks that share a bucket. A linked group doesn't meet itself; groups meet before their chunks
    do, so that a bucket of one such group makes no rows."""
    meets = large.select("key", "node").join(chunks, "node").select("key", "chunk").distinct()
    meets = materialize(meets.withColumn("group", F.struct("chunk.k", "chunk.linked")))
    groups = meets.select("key", "group").distinct()
    facing = groups.toDF("key", "gl").join(groups.toDF("key", "gr"), "key").where("gl < gr OR (gl = gr AND NOT gl.linked)")
    out = facing.join(meets.toDF("key", "left", "gl"), ["key", "gl"]).join(meets.toDF("key", "right", "gr"), ["key", "gr"])
    return out.where("left <= right").select("left", "right").distinct()


class Join:
    """The join of ``docs`` with itself; ``membership`` and ``survivors`` are its results. Without ``counts`` it knows
    components only, at less cost."""

    def __init__(self, docs: DataFrame, *, n: int = 5, threshold: float = 0.8, recall: float = 0.999, counts: bool = True) -> None:
        small_batches(docs.sparkSession)
        self.n, self.threshold, self.counts = n, threshold, counts
        bands, rows = bands_for(threshold, recall)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        hashed = self.docs.withColumn("h", F.xxhash64("text"))
        self.rows = materialize(hashed.mapInArrow(_signatures(n, bands, rows), "doc_id long, node long, n_grams long, h long, bands array<long>"))
        first = F.min(F.struct(F.coalesce("doc_id", F.lit(_LOW)).alias("rep"), "h")).alias("f")
        nodes = self.rows.where("n_grams > 0").groupBy("node").agg(first, F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
        self.nodes = materialize(nodes.select("node", "f.rep", "f.h", "n_grams", "bands"))
        members = self.nodes.select(F.explode("bands").alias("key"), "node", "n_grams")
        buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("of")).where("of > 1")
        members = materialize(members.join(buckets, "key"))
        large = members.where(F.col("of") > SMALL)
        home = _homes(large)
        edges = []
        if not counts:
            edges.append(self._pivot_edges(home))
            found = components(edges[0])
            home = home.join(found, "node", "left").select("node", "n_grams", F.coalesce("component", "key").alias("key"), F.col("component").isNotNull().alias("linked"))
        self.chunks = materialize(_chunks(home).select("node", "chunk"))
        self.tiles = materialize(_tiles(large, self.chunks))
        pairs = materialize(self._pairs(members.where(F.col("of") <= SMALL)))
        involved = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(self.chunks.select("node")).distinct()
        texts = materialize(self._texts_of(involved))

        both = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")
        self.links = materialize(both.mapInArrow(_similar(n), "a long, b long, similarity double").distinct().where(F.col("similarity") >= threshold))
        sides = self.tiles.select("left", "right", F.explode(F.when(F.col("left") == F.col("right"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
        sides = sides.withColumn("chunk", F.when(F.col("side") == 0, F.col("left")).otherwise(F.col("right")))
        laid = sides.join(self.chunks, "chunk").join(texts, "node").select("left", "right", "side", "node", "text")
        self.tiled = materialize(laid.groupBy("left", "right").applyInArrow(_tile(n, threshold), "a long, b long, n long"))
        edges += [self.links.select("a", "b"), self.tiled.where("b IS NOT NULL").select("a", "b")]
        self.parts = components(functools.reduce(DataFrame.unionByName, edges))

    def _texts_of(self, nodes: DataFrame) -> DataFrame:
        """(node, text) of text classes, one text each: that of the row that stands for the class by doc_id and text hash.
        Rows that repeat it are dropped in their task, before anything is sent."""
        reps = self.nodes.select("node", "rep", "h").join(nodes, "node", "left_semi")
        of = self.docs.select(F.coalesce("doc_id", F.lit(_LOW)).alias("rep"), F.xxhash64("text").alias("h"), "text")
        return of.join(reps, ["rep", "h"]).select("node", "text").dropDuplicates(["node"])

    def _pivot_edges(self, home: DataFrame) -> DataFrame:
        """Edges (a, b) between classes of large buckets and the pivots of their bucket. A pivot goes to each chunk once."""
        c = _chunks(home.withColumn("linked", F.lit(False)))
        drawn = F.array_distinct(F.array(*(F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node"))["node"] for i in range(PIVOTS))))
        chosen = home.groupBy("key").agg(drawn.alias("nodes")).select("key", F.explode("nodes").alias("node"))
        faced = c.select("key", "chunk").distinct().join(chosen, "key").select("chunk", F.lit(1).alias("side"), "node")
        sides = materialize(c.select("chunk", F.lit(0).alias("side"), "node").unionByName(faced))
        laid = sides.join(self._texts_of(sides.select("node").distinct()), "node").select("chunk", "side", "node", "text")
        found = laid.groupBy("chunk").applyInArrow(_tile(self.n, self.threshold), "a long, b long, n long")
        return materialize(found.where("b IS NOT NULL").select("a", "b"))

    def _pairs(self, few: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) of small buckets whose sizes allow the threshold and which no tile or component holds."""
        few = few.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n_grams"))).alias("l"))  # SMALL at most
        pairs = few.select(F.posexplode("l").alias("i", "x"), "l").select("x", F.explode(F.expr("slice(l, i + 2, size(l))")).alias("y"))
        fits = F.least("x.n_grams", "y.n_grams") >= F.greatest("x.n_grams", "y.n_grams") * F.lit(self.threshold) - 1e-9
        pairs = pairs.where(fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
        pairs = pairs.join(self.chunks.toDF("a", "ca"), "a", "left").join(self.chunks.toDF("b", "cb"), "b", "left")
        connected = F.coalesce(F.col("ca.linked") & F.col("cb.linked") & (F.col("ca.k") == F.col("cb.k")), F.lit(False))
        pairs = pairs.where(~connected).withColumn("own", F.col("ca").isNotNull() & F.col("cb").isNotNull())
        pairs = pairs.withColumns({"ca": F.least("ca", "cb"), "cb": F.greatest("ca", "cb")})
        tiled = self.tiles.select(F.col("left").alias("ca"), F.col("right").alias("cb"), F.lit(True).alias("tiled"))
        return pairs.join(tiled, ["ca", "cb"], "left").where(~F.col("own") | F.col("tiled").isNull()).select("a", "b")

    @property
    def classes(self) -> DataFrame:
        """(node, component, rep) of all text classes; rep is the smallest doc_id."""
        out = self.nodes.select("node", "rep").join(self.parts, "node", "left")
        return out.select("node", F.coalesce("component", "node").alias("component"), "rep")

    @property
    def membership(self) -> DataFrame:
        """doc_id, class_id, n_links of each row of the documents."""
        if not self.counts:
            raise ValueError("a join without counts has no numbers of links")
        ends = self.links.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("n"))
        ends = ends.unionByName(self.tiled.where("n IS NOT NULL").select(F.col("a").alias("node"), "n")).groupBy("node").agg(F.sum("n").alias("n_links"))
        node = self.classes.join(ends, "node", "left")
        least = node.groupBy("component").agg(F.min("rep").alias("class_id"))
        node = node.join(least, "component").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
        apart = self.rows.where("n_grams = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
        out = self.rows.where("n_grams > 0").join(node, "node").select("doc_id", F.when(F.col("class_id") != _LOW, F.col("class_id")).alias("class_id"), "n_links")
        return out.unionByName(apart)

    @property
    def survivors(self) -> DataFrame:
        """(doc_id, h) of one row of each class: that of smallest doc_id (none sorts last) and then text hash; texts
        without words are each a class."""
        last = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
        first = self.rows.where("n_grams > 0").join(self.classes, "node").groupBy("component").agg(F.min(last).alias("f"))
        return first.select("f.doc_id", "f.h").unionByName(self.rows.where("n_grams = 0").select("doc_id", "h").distinct())


def jaccard_join(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """doc_id, class_id, n_links of each row."""
    return Join(docs, n=n, threshold=threshold, recall=recall).membership


def keep_one(docs: DataFrame, **parameters: object) -> DataFrame:
    """One row of ``docs`` of each class: that of smallest doc_id. A row is known by doc_id and text: rows that share a
    doc_id (or have none) with different texts are judged apart, equal rows are one."""
    keep = Join(docs, counts=False, **parameters).survivors.select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"))
    names = [f"`{c}`" for c in docs.columns]
    d = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    kept = d.join(keep, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_h")), "left_semi")
    return kept.dropDuplicates(["_id", "_text"]).select("row.*")
