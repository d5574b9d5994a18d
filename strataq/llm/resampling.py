"""Importance resampling of documents towards a target set of texts.

Features are the runs of one to three consecutive words, hashed by CRC-32 into ``BUCKETS``. Both sides' features are
counted in one pass each; a bucket's gain is the logarithm of its share in the target over that in the documents, so the
weight of a text is a sum over one array, read at its features' buckets. A text's noise comes from its id, so equal
inputs give equal draws, and the drawn documents are those with the largest sums of weight and noise.

The cutoff of the draw is found without a sort. Each partition gives the median of its remaining keys and their number;
the median of these, weighted by the numbers, has at least a quarter of all remaining keys on either side, and one side is
discarded. The same job counts both sides and takes their medians, so a round is one job over narrow rows; what remains
is written again whenever it has halved. With no more than ``FEW`` keys left these decide. Only winners are sorted.

Order: score, largest first, then doc_id (none last), hash of the text, row; so the draw is exact whatever is tied.

CRCs of all words of a block of text are worked out at once: the checksum is linear, so a byte's share depends on its
value and its distance from the word's end, and words are appended by shifting what stands before them.

Edge cases: a null or empty text, or one without words, has no features and weight 0; a null doc_id draws the noise of an
empty id; rows that share a doc_id are scored and drawn apart, repeated rows too; an empty target or empty documents give
gains of the smoothing alone; long words and texts are worked on in blocks; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.runtime import materialize, small_batches
from strataq.llm.words import slices

BUCKETS = 10_000
#: Keys that are looked at one by one when so few remain.
FEW = 20_000
#: Bytes of one long text that are worked on at a time.
BLOCK = 1 << 20
_FULL = np.uint32(0xFFFFFFFF)
_POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, bits reflected
#: Words are bytes of UTF-8 outside ASCII, digits and letters; A-Z are lower-cased.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _bytewise() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1)
    return t.astype(np.uint32)


_BYTE = _bytewise()


def _next(state: np.ndarray) -> np.ndarray:
    """States after one more byte of zero."""
    return _BYTE[state & np.uint32(255)] ^ (state >> np.uint32(8))


def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables [4 bytes of a state, value]: of 0 to 64 zero bytes, and of 64, 128, 256, ... of them."""
    t = [np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]]
    for _ in range(64):
        t.append(_next(t[-1]))
    double = [t[64]]
    for _ in range(26):
        double.append(_put(double[-1], double[-1]))
    return np.stack(t), double


def _put(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    b = [(state >> np.uint32(8 * k)) & np.uint32(255) for k in range(4)]
    return table[0][b[0]] ^ table[1][b[1]] ^ table[2][b[2]] ^ table[3][b[3]]


_SHIFT, _DOUBLE = _shifts()
_FLAT = np.ascontiguousarray(_SHIFT.reshape(-1))
#: A byte's share in a checksum: [bytes after it, value].
_SHARE = np.ascontiguousarray(_SHIFT[1:, 0, :].reshape(-1))


def _shifted(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """States after ``n`` zero bytes each."""
    at = (n & 63) << 10
    out = _FLAT[at | (state & np.uint32(255))]
    for k in range(1, 4):
        out = out ^ _FLAT[at | (k << 8) | ((state >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int64)]
    more = n >> 6
    if len(more) and (most := int(more.max())):
        for p in range(most.bit_length()):
            i = np.flatnonzero((more >> p) & 1)
            out[i] = _put(_DOUBLE[p], out[i])
    return out


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(checksums from state 0, lengths, word offsets of each text) of the words of some texts."""
    solid = _WORD[data]
    before, after = np.zeros_like(solid), np.zeros_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    before[offs[:-1][offs[:-1] < len(data)]] = False
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    n = ends - starts
    if not len(n):
        return np.zeros(0, np.uint32), n, np.zeros(len(offs), np.int64)
    first = np.cumsum(n) - n
    behind = np.repeat(first + n - 1, n) - np.arange(int(n.sum()), dtype=np.int64)
    share = _SHARE[((behind & 63) << 8) | _LOWER[data[solid]]]
    if int(n.max()) > 64:
        far = np.flatnonzero(behind > 63)
        share[far] = _shifted(share[far], behind[far] & ~np.int64(63))
    return np.bitwise_xor.reduceat(share, first), n, np.searchsorted(starts, offs)


def _runs(crc: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Buckets of the runs of one, two and three words that begin at each word (one array each, shorter at the end)."""
    state, out = np.full(len(n), _FULL), []
    for k in range(3):
        m = len(n) - k
        if m <= 0:
            out.append(np.zeros(0, np.int64))
            continue
        if k:
            state = _next(state[:m] ^ np.uint32(0x20))
        state = _shifted(state, n[k:]) ^ crc[k:]
        out.append(((state ^ _FULL) % np.uint32(BUCKETS)).astype(np.int64))
    return out


def _blocks(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in blocks that end outside words."""
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and _WORD[data[end - 1]] and _WORD[data[end]]:
            gap = np.flatnonzero(~_WORD[data[end : end + BLOCK]])
            end = end + int(gap[0]) if len(gap) else min(len(data), end + BLOCK)
        yield data[at:end]
        at = end


def features(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, words of each text, text of each feature, bucket of each feature) of successive texts. A long text
    comes in several parts."""
    for a, b, data, offs in slices(col):
        if b - a > 1 or len(data) <= BLOCK:
            crc, n, woff = _words(data, offs)
            text = np.repeat(np.arange(b - a), np.diff(woff))
            who, bucket = [], []
            for k, x in enumerate(_runs(crc, n)):
                same = text[: len(x)] == text[k:]
                who.append(text[: len(x)][same]), bucket.append(x[same])
            yield a, np.diff(woff), np.concatenate(who), np.concatenate(bucket)
            continue
        crc, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for part in _blocks(data):
            more, m, _ = _words(part, np.array([0, len(part)]))
            old = len(n)
            crc, n = np.concatenate([crc, more]), np.concatenate([n, m])
            # of the two words carried along, only runs that end in the new ones are new
            bucket = np.concatenate([x[max(0, old - k) :] for k, x in enumerate(_runs(crc, n))])
            yield a, np.array([len(m)]), np.zeros(len(bucket), np.int64), bucket
            crc, n = crc[-2:], n[-2:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for _, _, _, bucket in features(b.column("text")):
            total += np.bincount(bucket, minlength=BUCKETS)
    i = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bucket": i, "n": total[i]})


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often all texts have each bucket; BUCKETS numbers come to the driver."""
    counts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, thousandths of the logarithm of its smoothed share in the target over that in the source."""
    s, t = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log(((b + 1.0) * s) / ((a + 1.0) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n, weight = (np.zeros(len(b), np.int64) for _ in range(3))
            for a, m, who, bucket in features(b.column("text")):
                part = slice(a, a + len(m))
                words[part] += m
                n[part] += np.bincount(who, minlength=len(m))
                inside = np.concatenate([[0], np.cumsum(gain[bucket[np.argsort(who, kind="stable")]])])
                ends = np.cumsum(np.bincount(who, minlength=len(m)))
                weight[part] += inside[ends] - inside[np.append(0, ends[:-1])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "h", "n_words", "n_features", "weight"])

    return run


def _noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number that the id decides."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, *, seed: int = 42) -> DataFrame:
    """doc_id, h (hash of the text), n_words, n_features, weight, score, row of each row; written."""
    small_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs), bucket_counts(target))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    weighed = d.mapInArrow(_weighed(gain), "doc_id long, h long, n_words long, n_features long, weight long")
    return materialize(weighed.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id()))


#: A row's key: smaller keys are drawn first.
KEY = ["low", "none", "id", "h", "row"]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select((-F.col("score")).alias("low"), F.col("doc_id").isNull().cast("long").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h", "row")


def _upto(keys: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Which rows of ``keys`` are at most ``limit``, column by column."""
    less, same = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    for c, v in zip(keys.T, limit, strict=True):
        less |= same & (c < v)
        same &= c == v
    return less | same


def _middle(keys: np.ndarray) -> list[int] | None:
    """The lower median of some keys."""
    return keys[np.lexsort(keys.T[::-1])[(len(keys) - 1) // 2]].tolist() if len(keys) else None


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in KEY], 1) if len(b) else np.zeros((0, len(KEY)), np.int64)


def _divided(above: list[int] | None, pivot: list[int] | None, limit: list[int] | None):
    """Of a partition's keys in (above, pivot] and in (pivot, limit]: numbers and medians."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([np.zeros((0, len(KEY)), np.int64), *(_remaining(_matrix(b), above, limit) for b in batches)])
        early = _upto(keys, np.array(pivot)) if pivot else np.zeros(len(keys), bool)
        sides = [keys[early], keys[~early]]
        yield pa.RecordBatch.from_pydict({"n": [[len(s) for s in sides]], "middle": [[_middle(s) for s in sides]]}, schema=pa.schema([("n", pa.list_(pa.int64())), ("middle", pa.list_(pa.list_(pa.int64())))]))

    return run


def _remaining(keys: np.ndarray, above: list[int] | None, limit: list[int] | None) -> np.ndarray:
    if limit is not None:
        keys = keys[_upto(keys, np.array(limit))]
    return keys if above is None else keys[~_upto(keys, np.array(above))]


def _weighted_median(parts: list[tuple[list[int], int]]) -> list[int]:
    """The first median up to which partitions hold half of all keys."""
    half, seen = (sum(n for _, n in parts) + 1) // 2, 0
    for middle, n in sorted(parts):
        seen += n
        if seen >= half:
            return middle
    raise ValueError("no keys")


def _key_column() -> Column:
    return F.struct(*KEY)


def _key_literal(key: list[int]) -> Column:
    return F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip(KEY, key, strict=True)))


def cutoff(keys: DataFrame, k: int, *, few: int = FEW) -> list[int] | None:
    """The ``k``-th smallest of the rows of ``keys`` (columns ``KEY``); none where there are fewer or ``k`` is 0."""
    small_batches(keys.sparkSession)
    above = pivot = limit = None
    written = left = None
    while k > 0:
        parts = [(r["n"], r["middle"]) for r in keys.mapInArrow(_divided(above, pivot, limit), "n array<long>, middle array<array<long>>").collect()]  # one a partition
        early = sum(n[0] for n, _ in parts)
        if pivot is not None and k <= early:
            side, limit = 0, pivot
        else:
            side, above, k = 1, pivot if pivot is not None else above, k - early
        here = [(middle[side], n[side]) for n, middle in parts if n[side]]
        left = sum(n for _, n in here)
        if k > left:
            return None
        rest = keys
        if above is not None:
            rest = rest.where(_key_column() > _key_literal(above))
        if limit is not None:
            rest = rest.where(_key_column() <= _key_literal(limit))
        if left <= few:
            return sorted(list(r) for r in rest.select(*KEY).collect())[k - 1]
        pivot = _weighted_median(here)
        written = written or left
        if 2 * left <= written:
            keys, written = materialize(rest), left
    return None


def _sorted_with_rank(winners: DataFrame) -> DataFrame:
    """Winners with their rank, from 1: dealt by ranges of keys, counted in each range, and moved on by what lies before."""
    placed = materialize(winners.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("place", F.monotonically_increasing_id()))
    part = F.call_function("shiftright", F.col("place"), F.lit(33))  # the id of a row is its partition's times 2**33, plus its place there
    before, offsets = 0, []
    for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # one a partition
        offsets.append((r["part"], before))
        before += r["n"]
    starts = placed.sparkSession.createDataFrame(offsets, "part long, before long")
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return ranked.withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "before", "place")


def draw(rows: DataFrame, *, percent: int = 5, min_words: int = 20, few: int = FEW) -> DataFrame:
    """``rows`` of ``scored`` with ``rank``: 1, 2, ... for the drawn share of those with ``min_words``, null for others."""
    able = F.col("n_words") >= min_words
    keys = materialize(_keyed(rows.where(able)))
    limit = cutoff(keys, percent * keys.count() // 100, few=few)
    names = rows.columns
    if limit is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    whole = rows.withColumns({"low": -F.col("score"), "none": F.col("doc_id").isNull().cast("long"), "id": F.coalesce("doc_id", F.lit(0))})
    drawn = able & (_key_column() <= _key_literal(limit))
    won = _sorted_with_rank(whole.where(drawn)).select(*names, "rank")
    return won.unionByName(whole.where(~drawn).select(*names, F.lit(None).cast("long").alias("rank")))


def importance_resampling(docs: DataFrame, target: DataFrame, *, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row."""
    return draw(scored(docs, target, seed=seed), percent=percent, min_words=min_words).select("doc_id", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, *, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """The drawn rows of ``docs``, with all their columns. Of equal rows (same id and text) at the cutoff so many are
    taken as were drawn."""
    rows = draw(scored(docs, target, seed=seed), percent=percent, min_words=min_words)
    times = rows.groupBy("doc_id", "h").agg(F.count("rank").alias("drawn"), F.count(F.lit(1)).alias("all")).where("drawn > 0")
    times = materialize(times.withColumnsRenamed({"doc_id": "_doc", "h": "_h"}))
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_h"))
    out = d.join(times.where("drawn = all"), same, "left_semi").select("row.*")
    for r in times.where("drawn < all").collect():  # the key at the cutoff, if it is repeated
        out = out.unionByName(d.where(F.col("_id").eqNullSafe(F.lit(r["_doc"])) & (F.col("_text") == r["_h"])).limit(r["drawn"]).select("row.*"))
    return out
