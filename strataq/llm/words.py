"""Words of many texts at once, as 64-bit names, by numpy over the UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes outside ``0x20, 0x09-0x0D``. UTF-8 continuation bytes are never in that set, so
splitting bytes and splitting characters give the same words. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RNG = np.random.default_rng(20240501)
_TABLE = _RNG.integers(0, 2**64, size=64 * 256, dtype=np.uint64)
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text that are worked on at a time.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


def slices(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``SLICE`` bytes; a longer row is a run of its own."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    col = col.fill_null("")
    if not len(col):
        return
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE, "right")) - 1)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def named(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, word offsets of each text, first byte, end byte) of the words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), z, z
    solid = ~SPACE[data]
    before, after = np.empty_like(solid), np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    after[-1], after[:-1] = False, solid[1:]
    before[offs[:-1][offs[:-1] < len(data)]] = False
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    woff = np.searchsorted(starts, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), woff, starts, ends
    lens = ends - starts
    first = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    v = _TABLE[((pos & 63) << 8) | data[solid]]
    if int(lens.max()) > 64:
        far = pos >= 64
        v[far] = mix(v[far] + (pos[far] >> 6).astype(np.uint64) * _K1)
    return mix(np.add.reduceat(v, first) + lens.astype(np.uint64) * _K1), woff, starts, ends


def rolling(names: np.ndarray, k: int) -> np.ndarray:
    """Names of all runs of ``k`` successive words; those that cross texts are for the caller to leave out."""
    n = len(names) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = np.random.default_rng(77 + k).integers(0, 2**63, size=k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = names[:n] * c[0]
    for j in range(1, k):
        out += names[j : j + n] * c[j]
    return mix(out)


def inside(woff: np.ndarray, k: int) -> np.ndarray:
    """Starts of the runs of ``k`` words that lie in one text."""
    n = np.maximum(np.diff(woff) - k + 1, 0)
    first = np.repeat(woff[:-1] - (np.cumsum(n) - n), n)
    return first + np.arange(int(n.sum()))
