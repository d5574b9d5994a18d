"""Packing of documents into windows of ``window`` tokens.

A document's ids and one end id are cut into full windows, each a sequence of its own, and a remainder. Of the
remainders' lengths only the histogram (at most window - 1 numbers) comes to the driver. There shallow combinations
that fill a window are enumerated; non-negative least squares finds how often each is used, rounded down to what the
histogram holds. Remainders that no combination takes are packed greedily one after the other, cut at the windows'
ends. All positions follow from a remainder's rank among those of its length, which Spark counts in buckets, so no
task holds more than one bucket of one length.

Edge cases: a null or empty text is its end id alone; rows that share a doc_id are packed separately; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataq.llm.runtime import bytes_of, materialize, small_batches
from strataq.llm.tokens import Encoder

#: Lengths, of those with most tokens, from which combinations of three are made.
TRIPLES_OF = 40
SWEEPS = 40
#: Sequences that the plan makes are numbered from here; those of full windows have numbers below.
PLANNED = 1 << 62


def combinations(histogram: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Lengths, at most three, that fill a window; single ones that are a power of two need no filling."""
    have = np.flatnonzero(histogram)
    there = set(have.tolist())
    out = [(int(a),) for a in have if a & (a - 1) == 0]
    out += [(int(a), int(window - a)) for a in have if 2 * a <= window and window - a in there]
    top = sorted(there, key=lambda a: (-histogram[a] * a, a))[:TRIPLES_OF]
    out += sorted({tuple(sorted((a, b, window - a - b))) for a in top for b in top if a <= b and window - a - b in there})
    return out


def non_negative_least_squares(columns: list[tuple[int, ...]], goal: np.ndarray) -> np.ndarray:
    """x >= 0 with least |A x - goal|, by coordinate descent; a column counts how often it has each length."""
    rest, x = goal.astype(float).copy(), np.zeros(len(columns))
    parts = [np.unique(c, return_counts=True) for c in columns]
    for _ in range(SWEEPS):
        most = 0.0
        for j, (i, k) in enumerate(parts):
            step = max(-x[j], float((rest[i] * k).sum()) / float((k * k).sum()))
            x[j] += step
            rest[i] -= step * k
            most = max(most, abs(step))
        if most < 0.5:
            break
    return x


def plan(histogram: np.ndarray, window: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], dict[int, tuple[int, int]], int]:
    """Where remainders go: by length (first rank, end rank, first sequence, offset); of the rest (first rank, first
    token in the row of all the rest); and the number of the first sequence of that row."""
    left, used = histogram.astype(np.int64).copy(), np.zeros(len(histogram), np.int64)
    columns = combinations(histogram, window)
    x = np.floor(non_negative_least_squares(columns, histogram)).astype(np.int64) if columns else np.zeros(0, np.int64)
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for whole in (x, np.full(len(columns), np.iinfo(np.int64).max)):  # first as solved, then whatever still fits
        for j in np.argsort(-whole, kind="stable"):
            kinds, k = np.unique(columns[j], return_counts=True)
            n = int(min(whole[j], (left[kinds] // k).min()))
            if n <= 0:
                continue
            offset = 0
            for a in columns[j]:
                slots.setdefault(a, []).append((int(used[a]), int(used[a]) + n, sequence, offset))
                used[a] += n
                left[a] -= n
                offset += a
            sequence += n
    rest, at = {}, 0
    for a in np.flatnonzero(left):
        rest[int(a)] = (int(used[a]), at)
        at += int(a) * int(left[a])
    return slots, rest, sequence


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _pieces(path: str, window: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path, ordinary=False)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.append(encoder.encode(text) if isinstance(text, str) else np.zeros(0, np.uint16), np.uint16(end_id))
                doc = None if pd.isna(doc) else int(doc)
                for s in range(0, len(ids), window):
                    part = ids[s : s + window]
                    rows.append((doc, s, len(part), _crc(part), len(ids), part.tobytes() if len(part) < window else None))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
            yield out.astype({"doc_id": "Int64"})

    return run


def _placed(slots: dict, rest: dict, first: int, window: int):
    starts = {a: np.array([s[0] for s in v]) for a, v in slots.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, start, n, crc, total, raw, rank in pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "rank"]].itertuples(index=False, name=None):
                doc = None if pd.isna(doc) else int(doc)
                if n in rest and rank >= rest[n][0]:
                    at = rest[n][1] + (rank - rest[n][0]) * n
                    head = min(n, window - at % window)
                    if head == n:
                        rows.append((doc, start, n, crc, total, PLANNED + first + at // window, at % window))
                    else:
                        ids = np.frombuffer(raw, np.uint16)
                        rows.append((doc, start, head, _crc(ids[:head]), total, PLANNED + first + at // window, at % window))
                        rows.append((doc, start + head, n - head, _crc(ids[head:]), total, PLANNED + first + at // window + 1, 0))
                else:
                    lo, _, sequence, offset = slots[n][int(np.searchsorted(starts[n], rank, "right")) - 1]
                    rows.append((doc, start, n, crc, total, PLANNED + sequence + rank - lo, offset))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            yield out.astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, *, tokenizer: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) that hold each id exactly once."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = max(16, bytes_of(docs) // (16 << 20))
    cut = docs.mapInPandas(_pieces(tokenizer, window, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    cut = materialize(cut.withColumn("row", F.monotonically_increasing_id()))
    full = cut.where(F.col("length") == window)
    rest = cut.where(F.col("length") < window).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = rest.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(window, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most window - 1 rows
        histogram[r["length"]] = r["n"]
    slots, left, first = plan(histogram, window)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = rest.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1)
    ranked = ranked.join(counts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.mapInPandas(_placed(slots, left, first, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).unionByName(placed)
