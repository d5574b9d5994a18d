"""Benchmark decontamination, by DataFrame functions only.

Words are lower-cased runs of letters and digits, shingles are hashes of ``n`` of them. A document is looked at through
windows as long as an item (one window where it is shorter). A window in which too few places have a shingle of any item
of its size can't reach the threshold and is left alone; where they are enough, *all* windows are laid, in blocks of
``SPAN`` starts, whatever the order in which they hold the item's shingles.

1. *Fingerprints.* Each laid window and each item gets a 64-bit SimHash of its shingles. Counts of set bits are summed
   in lanes of a long, so one pass over the shingles counts several bits at once.
2. *Multi-index.* Fingerprints within ``RADIUS`` bits agree in one of the blocks of ``BLOCKS`` up to that block's own
   few bits, by counting. Items are indexed under all values that near for each block; a window looks up its own values:
   a join on (size, block, bits), as one long, finds all fingerprints within the radius.
3. *Verification.* For each document and item so found, the exact weighted similarity (sum of smaller counts over sum of
   larger ones) of all laid windows of the item's size decides; the best and first one is reported.

A pair at exactly the threshold shares 8 of 9 shingles, so its fingerprints differ in 9.7 bits on average (standard
deviation 2.9): radius 18 finds 99.8 % of such pairs and more of all nearer ones.

Documents are never shuffled whole: their shingles meet the items' in a broadcast join while these are no more than
``BROADCAST_ROWS`` (counted first) and in a shuffle join beyond that; only documents with a hit are read again.

Edge cases: null or empty texts and items, and items of fewer than ``n`` words, match nothing; a document shorter than
an item is one window; repeated items each give their rows; a row is known by doc_id and text, so of rows that share a
doc_id only those that match go; they are reported under it once, with the best window; a null doc_id is a doc_id like
others; a null item_id is an item; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.runtime import materialize

RADIUS = 18
#: (first bit, bits, errors looked up) of each block. Fewer errors in all blocks than these sum up to at least
#: sum(errors + 1) = RADIUS + 1 errors, so within the radius one block has no more than its own.
BLOCKS = [(0, 13, 3), (13, 13, 3), (26, 13, 3), (39, 13, 3), (52, 12, 2)]
#: Window starts that are laid together.
SPAN = 64
BROADCAST_ROWS = 400_000
_WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(_WORD), F.lit(0))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles(w: Column, n: int) -> Column:
    """Hashes of the runs of ``n`` words, in order."""
    at = F.sequence(F.lit(0), F.size(w) - n)
    return F.when(F.size(w) >= n, F.transform(at, lambda i: F.xxhash64(*(w[i + k] for k in range(n))))).otherwise(F.array().cast("array<bigint>"))


def simhash(g: Column, lane: int = 16) -> Column:
    """64 bits: of each, whether more than half of the hashes have it set. ``lane`` bits count each: 16 for up to 32,767
    hashes, 32 beyond."""
    ones, whole = (F.lit(x).cast("long") for x in (sum(1 << at for at in range(0, 64, lane)), (1 << lane) - 1))
    zero, one, shift = F.lit(0).cast("long"), F.lit(1).cast("long"), lambda x, n: F.call_function("shiftrightunsigned", x, n)

    def of(h: Column) -> Column:
        counts = F.transform(F.sequence(F.lit(0), F.lit(lane - 1)), lambda j: F.aggregate(h, zero, lambda a, x: a + shift(x, j).bitwiseAND(ones)))

        def bits(c: Column) -> Column:
            often = lambda b: 2 * shift(F.get(c, b % lane), b - b % lane).bitwiseAND(whole) > F.size(h)
            return F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, lambda a, b: F.when(often(b), a.bitwiseOR(F.call_function("shiftleft", one, b))).otherwise(a))

        return _once(counts, bits)

    return F.coalesce(_once(g, of), zero)  # never null, so that joins need no test of it


def block_bits(fingerprint: Column) -> list[Column]:
    """The fingerprint's bits in each block."""
    return [F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for at, width, _ in BLOCKS]


def _key(size: Column, k: int, bits: Column) -> Column:
    return F.shiftleft(size.cast("long") * len(BLOCKS) + k, max(width for _, width, _ in BLOCKS)).bitwiseOR(bits)


def lookups(size: Column, fingerprint: Column) -> Column:
    """The keys (size, block, bits) of a window."""
    return F.array(*(_key(size, k, bits) for k, bits in enumerate(block_bits(fingerprint))))


def entries(size: Column, fingerprint: Column) -> Column:
    """The keys of all values that differ from the fingerprint's in no more than the block's errors."""

    def near(k: int, bits: Column) -> Column:
        _, width, errors = BLOCKS[k]
        masks = F.filter(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda m: F.bit_count(m) <= errors)
        return F.transform(masks, lambda m: _key(size, k, bits.bitwiseXOR(m.cast("long"))))

    return F.concat(*(near(k, bits) for k, bits in enumerate(block_bits(fingerprint))))


def occurrences(g: Column) -> Column:
    """A multiset of hashes as a set: the k-th occurrence of a hash is an entry of its own. Linear but for one sort."""

    def runs(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == F.size(s) - 1) | (F.get(s, i) != F.get(s, i + 1)))

        def numbered(e: Column) -> Column:
            return F.flatten(F.transform(e, lambda end, j: F.transform(F.sequence(F.lit(1), end - F.coalesce(F.get(e, j - 1), F.lit(-1))), lambda k: F.xxhash64(F.get(s, end), k))))

        return _once(ends, numbered)

    return F.when(F.size(g) > 0, _once(F.array_sort(g), runs)).otherwise(F.array().cast("array<bigint>"))


def _blocks(at: Column, of: Column, m: Column, threshold: float) -> Column:
    """Blocks of starts in which a window can reach the threshold. Two multisets of m and w shingles are as similar only if
    they share ``need`` of them, so that many of a window's places must be among ``at``, those of shingles of any item of
    this size: of each ``need`` such places in a row that one window can hold, the starts of all windows that do."""
    w = F.least(m, of)
    need = F.ceil((m + w) * F.lit(threshold / (1 + threshold)) - 1e-9).cast("int")

    def starts(i: Column) -> Column:
        low = F.greatest(F.lit(0), F.get(at, i + need - 1) - w + 1)
        return F.sequence(F.floor(low / SPAN).cast("int"), F.floor(F.least(of - w, F.get(at, i)) / SPAN).cast("int"))

    firsts = F.filter(F.sequence(F.lit(0), F.size(at) - need), lambda i: F.get(at, i + need - 1) - F.get(at, i) < w)
    return F.when(F.size(at) >= need, F.array_distinct(F.flatten(F.transform(firsts, starts)))).otherwise(F.array().cast("array<int>"))


def _rows(docs: DataFrame, doc_id: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))


def matches(docs: DataFrame, benchmark: DataFrame, *, n: int = 5, threshold: float = 0.8, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, h (hash of the row's text), item_id, start (first word of the best window), similarity."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("iw"))
    items = items.where(F.size("iw") >= n).select("item_id", F.size("iw").alias("size"), (F.size("iw") - n + 1).alias("m"), shingles(F.col("iw"), n).alias("ig"))
    seeds = items.select("size", "m", F.explode("ig").alias("g")).distinct()
    much = items.agg(F.count(F.lit(1)), F.sum("m"), F.max("m")).first()  # a benchmark's size decides how it is joined
    lane = 16 if (much[2] or 0) < 1 << 15 else 32
    per_item = sum(math.comb(width, e) for _, width, errors in BLOCKS for e in range(errors + 1))
    bounded = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df
    seeds = bounded(seeds, much[1] or 0)

    texts = _rows(docs, doc_id)
    grams = _once(words(F.col("text")), lambda w: shingles(w, n))
    places = texts.select("doc_id", "h", grams.alias("gs")).select("doc_id", "h", F.size("gs").alias("of"), F.posexplode("gs").alias("p", "g"))
    hits = places.join(seeds, "g").groupBy("doc_id", "h", "of", "size", "m").agg(F.sort_array(F.collect_set("p")).alias("at"))  # places of one text
    hits = hits.withColumn("b", _blocks(F.col("at"), F.col("of"), F.col("m"), threshold)).where(F.size("b") > 0)
    laid = hits.groupBy(F.col("doc_id").alias("_doc"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("size", "m", "b")).alias("laid"))  # one a size of items

    here = texts.join(laid, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h"))).dropDuplicates(["doc_id", "h"])
    here = here.select("doc_id", "h", grams.alias("gs"), "laid").select("doc_id", "h", "gs", F.inline("laid")).withColumn("b", F.explode("b"))
    last = F.greatest(F.lit(0), F.size("gs") - F.col("m"))  # the last start of a window
    here = here.withColumn("from", F.col("b") * SPAN).withColumn("upto", F.least(F.col("from") + SPAN - 1, last)).where("upto >= `from`")
    here = here.select("doc_id", "h", "size", "m", "from", (F.col("upto") - F.col("from")).alias("more"), F.slice("gs", F.col("from") + 1, F.col("upto") - F.col("from") + F.col("m")).alias("g"))
    here = materialize(here)  # some hundred bytes a hit
    windows = here.select("doc_id", "h", "size", "m", "from", "g", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("i"))
    windows = windows.select("doc_id", "h", "size", (F.col("from") + F.col("i")).alias("start"), F.slice("g", F.col("i") + 1, F.col("m")).alias("g"))

    keyed = windows.select("doc_id", "h", "size", simhash(F.col("g"), lane).alias("f"))
    keyed = keyed.select("doc_id", "h", "size", "f", F.explode(lookups(F.col("size"), F.col("f"))).alias("key"))
    index = items.select("item_id", "size", simhash(F.col("ig"), lane).alias("if"))
    index = bounded(index.select("item_id", "if", F.explode(entries(F.col("size"), F.col("if"))).alias("key")), (much[0] or 0) * per_item)
    near = keyed.join(index, "key").where(F.bit_count(F.col("f").bitwiseXOR(F.col("if"))) <= RADIUS)
    near = near.select("doc_id", "h", "item_id", "size").distinct()

    near = near.join(bounded(items.select(F.col("item_id").alias("_item"), F.col("size").alias("_size"), F.size("ig").alias("all"), occurrences(F.col("ig")).alias("io")), (much[0] or 0)), F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("size") == F.col("_size"))).drop("_item", "_size")
    near = near.withColumnsRenamed({"doc_id": "_doc", "h": "_h", "size": "_size"})
    both = windows.join(near, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h")) & (F.col("size") == F.col("_size")))
    both = both.select("doc_id", "h", "item_id", "start", (F.size("g") + F.col("all")).alias("all"), F.size(F.array_intersect(occurrences(F.col("g")), "io")).alias("both"))
    both = both.withColumn("all", F.col("all") - F.col("both"))
    sure = both.where(F.col("both") >= F.col("all") * F.lit(threshold) - 1e-9).withColumn("similarity", F.col("both") / F.col("all"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s")))
    return sure.groupBy("doc_id", "h", "item_id").agg(best.alias("b")).select("doc_id", "h", "item_id", (-F.col("b.s")).cast("long").alias("start"), F.col("b.similarity").alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **parameters: object) -> DataFrame:
    """doc_id, item_id, start (first word of the best window), similarity of each document and item that match."""
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s")))
    m = matches(docs, benchmark, **parameters).groupBy("doc_id", "item_id").agg(best.alias("b"))
    return m.select("doc_id", "item_id", (-F.col("b.s")).alias("start"), F.col("b.similarity").alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", **parameters: object) -> DataFrame:
    """``docs`` without the rows that match an item."""
    gone = matches(docs, benchmark, doc_id=doc_id, **parameters).select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h")).distinct()
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{doc_id}`").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    return d.join(gone, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_h")), "left_anti").select("row.*")
