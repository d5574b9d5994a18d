"""Substring dedup by recompression.

Words are symbols of level 0. A first step names maximal runs of one word; each further round names the pairs that a
salted coin of the two names picks (left symbol heads, right symbol tails). A name is the 64-bit hash of what it stands
for, so all executors give equal substrings the same names with no dictionary. A named pair depends on its own words
and one neighbour on each side only (which decides where runs end), so a window of ``width`` words that occurs twice
holds the same interior symbols in both places.

As names are hashes of content, a round of naming needs no exchange: the four rounds run inside a block, and what is
shuffled is their result.

1. *Reveal.* The core of a window is its largest interior symbol. Blocks of documents send each distinct core once to
   buckets; a core that only one document holds rules out all its windows. What is shared goes back to the blocks.
2. *Verify.* Only windows with a shared core send the 64-bit hash of their full word sequence, with the block's smallest
   doc_id; buckets find the smallest doc_id of all and answer the blocks that have a larger one.
3. *Cut.* Blocks remove the words that such windows, or windows of a smaller document in the same block, cover.

Shuffled: the texts once (the exchange is reused), then packed integers. A block is at most ``MOST`` bytes of text at any
corpus size, and sends a core or window once however often it occurs in it, so a passage that all documents hold costs
eight bytes a block.

Edge cases: null text counts as empty (no words, hash of the empty string); fewer than ``width`` words: nothing is
removed; rows that share a doc_id are one document for the comparison and one result row each; null doc_id sorts
before all others; a text of any length is one row of a block; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.runtime import bytes_of, small_batches
from strataq.llm.words import inside, mix, named, rolling, slices

ROUNDS = 4
#: Bytes of text in a block, about: at least, and at most.
LEAST, MOST = 6 << 20, 32 << 20
_SALT = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.iinfo(np.int64).min


def cores(names: np.ndarray, woff: np.ndarray, width: int) -> np.ndarray:
    """For each window start (all positions; those that cross texts hold waste) the key of its largest interior symbol."""
    n, m = len(names), len(names) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    best = np.zeros(m, np.uint64)
    top = np.iinfo(np.int32).max

    def offer(at: np.ndarray, name: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: np.ndarray) -> None:
        """Symbols that start at word ``at`` and depend on words [lo, hi): offered to every window that holds these."""
        ok = hi - lo <= width
        at, name, lo, hi, words = at[ok], name[ok], lo[ok], hi[ok], words[ok]
        key = np.zeros(n, np.uint64)
        least, most = np.full(n, width, np.int8), np.full(n, -1, np.int8)
        key[at] = (np.minimum(words, 31).astype(np.uint64) << np.uint64(59)) | (name >> np.uint64(5))
        least[at], most[at] = at - lo, width - (hi - at)
        for o in range(width):
            k = key[o : o + m]
            np.maximum(best, k, out=best, where=(least[o : o + m] <= o) & (most[o : o + m] >= o))

    edge = np.zeros(n + 1, bool)
    edge[woff] = True
    at = np.arange(n)
    # level 0: every window holds its words, so each has a core
    one = np.ones(n, np.int64)
    offer(at, mix(names), at, at + 1, one)
    # maximal runs of a word
    new = np.ones(n, bool)
    new[1:] = (names[1:] != names[:-1]) | edge[1:n]
    s = np.flatnonzero(new)
    e = np.append(s[1:], n)
    run = e - s
    sym = np.where(run > 1, mix(names[s] + run.astype(np.uint64) * _SALT), names[s])
    lo, hi = np.where(edge[s], -top, s - 1), np.where(edge[e], top, e + 1)
    offer(s[run > 1], sym[run > 1], lo[run > 1], hi[run > 1], run[run > 1])
    for r in range(1, ROUNDS + 1):
        heads = (mix(sym ^ np.uint64(r * 0xA24BAED4963EE407 % 2**64)) & np.uint64(1)).astype(bool)
        pair = heads[:-1] & ~heads[1:] & ~edge[s[1:]]
        i = np.flatnonzero(pair)
        if not len(i):
            continue
        olo, ohi = lo.copy(), hi.copy()
        joined = mix(sym[i] * np.uint64(3) + mix(sym[i + 1] + np.uint64(r)))
        sym[i], e[i], hi[i] = joined, e[i + 1], hi[i + 1]
        lo[i] = np.minimum(lo[i], lo[i + 1])
        offer(s[i], joined, lo[i], hi[i], e[i] - s[i])
        keep = np.ones(len(s), bool)
        keep[i + 1] = False
        # an unpaired symbol stays because of a neighbour: heads of the one to the right, tails of the one to the left
        alone = keep.copy()
        alone[i] = False
        right, left = alone & heads, alone & ~heads
        nlo, nhi = lo.copy(), hi.copy()
        k = np.flatnonzero(right)
        nhi[k] = np.where(edge[e[k]], top, ohi[np.minimum(k + 1, len(s) - 1)])
        k = np.flatnonzero(left)
        nlo[k] = np.where(edge[s[k]], -top, olo[np.maximum(k - 1, 0)])
        s, e, sym, lo, hi = s[keep], e[keep], sym[keep], nlo[keep], nhi[keep]
    return best


def _ordered(t: pa.Table) -> pa.Table:
    """A block's documents in an order that every pass finds again."""
    return t.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _ids(t: pa.Table) -> np.ndarray:
    return t.column("doc_id").fill_null(_LOW).to_numpy()


def _packed(block: int, bucket: np.ndarray, **cols: np.ndarray) -> pa.Table:
    """One row for each bucket with the bytes of its share of ``cols``; ``bucket`` is in order."""
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    end = np.append(cut[1:], len(bucket)) if len(cut) else cut
    out = {"bucket": pa.array(bucket[cut].astype(np.int64)), "block": pa.array(np.full(len(cut), block, np.int64))}
    for k, v in cols.items():
        out[k] = pa.array([v[a:b].tobytes() for a, b in zip(cut, end, strict=True)], pa.binary())
    return pa.table(out)


def _joined(t: pa.Table, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The bytes column of all rows as one array, and how many entries each row gave."""
    parts = [np.frombuffer(x, kind) for x in t.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind), np.array([len(p) for p in parts], np.int64)


def _windows(t: pa.Table, width: int, key) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of a block's documents ``key(names, word offsets)`` and the doc_id."""
    ids, keys, who = _ids(t), [], []
    for a, _, data, offs in slices(t.column("text")):
        names, woff, _, _ = named(data, offs)
        w = inside(woff, width)
        if len(w):
            keys.append(key(names, woff)[w]), who.append(ids[a + np.searchsorted(woff, w, "right") - 1])
    return (np.concatenate(keys), np.concatenate(who)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _reveal(width: int, buckets: int):
    """A block's distinct cores, the last bit set where several of its documents hold one."""

    def run(t: pa.Table) -> pa.Table:
        key, doc = _windows(t, width, lambda names, woff: cores(names, woff, width))
        again = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])) if len(key) else np.zeros(0, bool)
        key, doc = key[again], doc[again]
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        if not len(key):
            return _packed(0, np.zeros(0, np.int64), core=key)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        key = (key[first] & ~np.uint64(1)) | many.astype(np.uint64)
        b = mix(key >> np.uint64(1)) % np.uint64(buckets)
        order = np.argsort(b, kind="stable")
        return _packed(t.column("block")[0].as_py(), b[order], core=key[order])

    return run


def _shared(t: pa.Table) -> pa.Table:
    """Cores that several documents hold, to the blocks that hold them."""
    core, n = _joined(t, "core", np.uint64)
    block = np.repeat(t.column("block").to_numpy(), n)
    order = np.argsort(core, kind="stable")
    core, block = core[order], block[order]
    first = np.flatnonzero(np.append(True, (core[1:] ^ core[:-1]) > 1)) if len(core) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(core)))
    # a block sends a core once, so two entries are two blocks
    many = (size > 1) | ((np.bitwise_or.reduceat(core, first) & np.uint64(1)).astype(bool) if len(first) else np.zeros(0, bool))
    keep = np.repeat(many, size)
    core, block = core[keep] & ~np.uint64(1), block[keep]
    order = np.argsort(block, kind="stable")
    got = _packed(0, block[order], core=core[order])
    return pa.table({"block": got.column("bucket"), "core": got.column("core")})


def _verify(width: int, buckets: int):
    """The full word sequences, by hash, of a block's windows whose core is shared, each with its smallest document."""

    def run(t: pa.Table, back: pa.Table) -> pa.Table:
        empty = {"window": np.zeros(0, np.uint64), "doc": np.zeros(0, np.int64)}
        if not len(t) or not len(back):
            return _packed(0, np.zeros(0, np.int64), **empty)
        shared = np.sort(_joined(back, "core", np.uint64)[0])

        def sequence(names: np.ndarray, woff: np.ndarray) -> np.ndarray:
            c = cores(names, woff, width) & ~np.uint64(1)
            at = np.minimum(np.searchsorted(shared, c), len(shared) - 1)
            return np.where(shared[at] == c, rolling(names, width), np.uint64(0))

        win, doc = _windows(t, width, sequence)
        win, doc = win[win != 0], doc[win != 0]
        if not len(win):
            return _packed(0, np.zeros(0, np.int64), **empty)
        b = win % np.uint64(buckets)
        order = np.lexsort((doc, win, b))
        win, doc, b = win[order], doc[order], b[order]
        first = np.flatnonzero(np.append(True, win[1:] != win[:-1]))
        return _packed(t.column("block")[0].as_py(), b[first], window=win[first], doc=doc[first])

    return run


def _smallest(t: pa.Table) -> pa.Table:
    """Windows that a document of another block with a smaller doc_id holds, to the blocks of the larger ones."""
    win, n = _joined(t, "window", np.uint64)
    doc, _ = _joined(t, "doc", np.int64)
    block = np.repeat(t.column("block").to_numpy(), n)
    order = np.lexsort((doc, win))
    win, doc, block = win[order], doc[order], block[order]
    first = np.flatnonzero(np.append(True, win[1:] != win[:-1])) if len(win) else np.zeros(0, np.int64)
    least = np.repeat(doc[first], np.diff(np.append(first, len(win))))
    late = doc > least
    win, block = win[late], block[late]
    order = np.argsort(block, kind="stable")
    got = _packed(0, block[order], window=win[order])
    return pa.table({"block": got.column("bucket"), "window": got.column("window")})


def _without(text: bytes, first: np.ndarray, end: np.ndarray, off: np.ndarray) -> bytes:
    """``text`` without its runs of covered words (``off``), each from its first word's start to its last word's end."""
    change = np.flatnonzero(np.diff(np.concatenate([[False], off, [False]])))
    out, at = [], 0
    for i, j in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
        out.append(text[at : int(first[i])])
        at = int(end[j - 1])
    return b"".join([*out, text[at:]])


def _cut(width: int, with_text: bool):
    def run(t: pa.Table, back: pa.Table) -> pa.Table:
        t = _ordered(t)
        ids = _ids(t)
        later = np.unique(_joined(back, "window", np.uint64)[0])
        parts, wins, who, where, base = [], [], [], [], 0
        for a, b, data, offs in slices(t.column("text")):
            names, woff, first, end = named(data, offs)
            w = inside(woff, width)
            parts.append((a, b, data, offs, woff, first, end))
            if len(w):
                wins.append(rolling(names, width)[w]), where.append(base + w)
                who.append(ids[a + np.searchsorted(woff, w, "right") - 1])
            base += len(names)
        gone = np.zeros(base + 1, np.int32)
        if wins:
            win, doc, at = np.concatenate(wins), np.concatenate(who), np.concatenate(where)
            order = np.lexsort((doc, win))
            win, doc, at = win[order], doc[order], at[order]
            first = np.flatnonzero(np.append(True, win[1:] != win[:-1]))
            dup = doc > np.repeat(doc[first], np.diff(np.append(first, len(win))))
            if len(later):
                i = np.minimum(np.searchsorted(later, win), len(later) - 1)
                dup |= later[i] == win
            np.add.at(gone, at[dup], 1), np.add.at(gone, at[dup] + width, -1)
        gone = np.cumsum(gone[:-1]) > 0
        words, removed, digest, kept, base = [], [], [], [], 0
        there = t.column("text").is_valid().to_pylist() if with_text else []
        for a, b, data, offs, woff, first, end in parts:
            raw = data.tobytes()
            for d in range(b - a):
                lo, hi = int(woff[d]), int(woff[d + 1])
                off = gone[base + lo : base + hi]
                k = int(off.sum())
                if k == 0:
                    left = raw[first[lo] : end[hi - 1]].split() if hi > lo else []
                else:
                    stay = lo + np.flatnonzero(~off)
                    left = [raw[i:j] for i, j in zip(first[stay].tolist(), end[stay].tolist(), strict=True)]
                out = b" ".join(left)
                words.append(hi - lo), removed.append(k), digest.append(hashlib.sha256(out).hexdigest())
                if with_text:
                    own = raw[int(offs[d]) : int(offs[d + 1])]
                    kept.append((own if k == 0 else _without(own, first[lo:hi] - offs[d], end[lo:hi] - offs[d], off)) if there[a + d] else None)
            base += len(first)
        cols = {"doc_id": t.column("doc_id").combine_chunks(), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if with_text:
            cols["kept_text"] = pa.array(kept, pa.binary()).cast(pa.string())
            cols["carried"] = t.column("carried").combine_chunks()
        return pa.table(cols)

    return run


def substring_dedup(docs: DataFrame, *, width: int = 13, with_text: bool = False) -> DataFrame:
    """Remove words covered by a window of ``width`` words that also starts in a document of smaller id.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space): one row for each row of
    ``docs``. With ``with_text`` also kept_text (what is left of the text itself, null if it was) and ``carried``, a struct
    of the row as it was but for its text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    carried = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("carried")] if with_text else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    size = 2 * bytes_of(docs)
    # entries of a bucket fit in memory; blocks grow a little with the corpus, so that a row from a block to a bucket
    # holds some dozens of entries as long as it can, and not beyond MOST
    buckets = max(48, size * 8 // 24 // (32 << 20))
    blocks = max(8, size // min(MOST, max(LEAST, 1500 * buckets)))
    d = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    by = lambda df, k: df.groupBy(k)
    found = by(d, "block").applyInArrow(_reveal(width, buckets), "bucket long, block long, core binary")
    shared = by(found, "bucket").applyInArrow(_shared, "block long, core binary")
    sent = by(d, "block").cogroup(by(shared, "block")).applyInArrow(_verify(width, buckets), "bucket long, block long, window binary, doc binary")
    later = by(sent, "bucket").applyInArrow(_smallest, "block long, window binary")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (f", kept_text string, carried {docs.schema['carried'].dataType.simpleString()}" if with_text else "")
    return by(d, "block").cogroup(by(later, "block")).applyInArrow(_cut(width, with_text), out)


def deduplicated(docs: DataFrame, *, width: int = 13) -> DataFrame:
    """``docs`` with the covered words cut out of their texts (and the length left as n_chars, if there); all other bytes,
    and texts that lose nothing, stay as they are. Documents that lost all words go."""
    out = substring_dedup(docs, width=width, with_text=True).where("n_removed < n_words OR n_words = 0")
    own = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") == 0, F.col("carried.n_chars")).otherwise(F.length("kept_text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else None}
    return out.select(*((own[c] if c in own else F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))
