"""Token counts that follow edits.

Each document keeps a segment tree over leaves of pre-tokens: a leaf is a run of text whose start is a space before a
visible character that begins no added token, where every byte-level pre-tokenizer starts a new pre-token whatever
stands before. An edit re-encodes only the leaves it touches, and the leaf before where it touches a leaf's first
characters, as far as an added token could reach (its boundary context); the sums above them are updated on the way to
the root.

Edge cases: null text counts as empty (one empty leaf, 0 tokens); edits outside the text are clipped to it; null or no
edits change nothing; an edit of nothing by nothing counts as an edit but encodes its leaf again; rows that share a
doc_id are counted separately; an empty table gives no rows; other columns are kept out of the result. A leaf is as long
as the text has no safe start: of text without spaces (Chinese, Japanese) a leaf is what lies between two spaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.runtime import small_batches
from strataq.llm.tokens import Encoder

#: Characters of text in a leaf, about; the cut is at the next safe start.
LEAF = 512


def safe_start(added: Iterable[str] = ()) -> re.Pattern:
    """A space before a visible character that begins none of the ``added`` tokens: what stands before an added token is
    a text of its own, whose last blanks go together."""
    return re.compile(" " + (f"(?!{'|'.join(map(re.escape, added))})" if added else "") + r"\S")


def leaves(text: str, size: int = LEAF, start: re.Pattern = safe_start()) -> list[str]:
    """Cut a text at safe starts, at least ``size`` characters apart."""
    out, at = [], 0
    while len(text) - at > size and (m := start.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class Tree:
    """A segment tree over leaf lengths and token counts: node i has children 2i and 2i + 1, leaves begin at ``base``."""

    def __init__(self, texts: list[str], counts: list[int] | np.ndarray) -> None:
        self.texts = texts
        self.base = 1 << max(0, len(texts) - 1).bit_length()
        self.sums = np.zeros((2 * self.base, 2), np.int64)
        self.sums[self.base : self.base + len(texts), 0] = [len(t) for t in texts]
        self.sums[self.base : self.base + len(texts), 1] = counts
        level = self.base
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, characters before it) of the leaf that holds character ``at``, or the last one for the text's end."""
        node, before = 1, 0
        if at >= self.chars:
            last = len(self.texts) - 1
            return last, self.chars - len(self.texts[last])
        while node < self.base:
            node *= 2
            if at >= before + self.sums[node, 0]:
                before += int(self.sums[node, 0])
                node += 1
        return node - self.base, before

    def put(self, leaf: int, text: str, count: int) -> None:
        self.texts[leaf] = text
        node = self.base + leaf
        step = np.array([len(text), count]) - self.sums[node]
        while node:
            self.sums[node] += step
            node //= 2

    def edit(self, start: int, n_delete: int, insert: str, encoder: Encoder) -> int:
        """Replace characters; returns how many characters were encoded again."""
        start = min(max(start, 0), self.chars)
        stop = min(start + max(n_delete, 0), self.chars)
        a, before = self.find(start)
        b = a if stop <= before + len(self.texts[a]) else self.find(stop - 1)[0]
        head, cut = a, before
        reach = 1 + max([1, *map(len, encoder.added)])
        while head and start < cut + reach:  # its start may no longer be safe: take the leaf before along
            head -= 1
            cut -= len(self.texts[head])
        joined = "".join(self.texts[head : b + 1])
        # what follows must begin at a safe start that the edit leaves alone, which the next leaf's is
        text = joined[: start - cut] + insert + joined[stop - cut :]
        for i in range(head + 1, b + 1):
            self.put(i, "", 0)
        self.put(head, text, encoder.count(text))
        return len(text)

    def settled(self, encoder: Encoder, size: int = LEAF) -> tuple[list[int], list[int]]:
        """(characters, tokens) of the leaves after edits: those left empty go, and those that have grown beyond twice
        their size are cut again at safe starts, so that later edits stay as cheap. Counts of parts add up to the whole."""
        start = safe_start(encoder.added)
        chars, tokens = [], []
        for i, text in enumerate(self.texts):
            if len(text) > 2 * size:
                parts = leaves(text, size, start)
                chars += map(len, parts)
                tokens += map(encoder.count, parts)
            elif text:
                chars.append(len(text))
                tokens.append(int(self.sums[self.base + i, 1]))
        return (chars, tokens) if chars else ([0], [0])


def _build(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path, ordinary=False)
        start = safe_start(encoder.added)
        for pdf in batches:
            cut = [leaves(t, start=start) if isinstance(t, str) else [""] for t in pdf["text"]]
            yield pdf.assign(leaf_chars=[[len(x) for x in c] for c in cut], leaf_tokens=[[encoder.count(x) for x in c] for c in cut])

    return run


def _apply(path: str, counts: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path, ordinary=False)
        for pdf in batches:
            rows = []
            for doc, text, chars, tokens, edits in zip(pdf["doc_id"], pdf["text"], pdf["leaf_chars"], pdf["leaf_tokens"], pdf["edits"], strict=True):
                text = text if isinstance(text, str) else ""
                ends = np.cumsum(chars)
                tree = Tree([text[e - n : e] for e, n in zip(ends, chars, strict=True)], tokens)
                was, again, done = tree.tokens, 0, 0
                for e in [] if edits is None else edits:
                    again += tree.edit(int(e["start"] or 0), int(e["n_delete"] or 0), e["insert"] or "", encoder)
                    done += 1
                doc = None if pd.isna(doc) else int(doc)
                rows.append((doc, was, tree.tokens, tree.chars, done, again) if counts else (doc, "".join(tree.texts), *tree.settled(encoder)))
            names = ["doc_id", "n_tokens", "n_tokens_after", "n_chars_after", "n_edits", "chars_encoded_again"] if counts else ["doc_id", "text", "leaf_chars", "leaf_tokens"]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return run


EDITS = "array<struct<start:long,n_delete:long,insert:string>>"


def token_trees(docs: DataFrame, *, tokenizer: str) -> DataFrame:
    """Leaf lengths and token counts of each document; with its text they are its tree. Write the result once and apply
    edits to what was written: only touched leaves are encoded then."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c) for c in ["edits"] if c in docs.columns))
    kinds = ", edits " + EDITS if "edits" in docs.columns else ""
    return d.mapInPandas(_build(tokenizer), f"doc_id long, text string{kinds}, leaf_chars array<long>, leaf_tokens array<long>")


def apply_edits(trees: DataFrame, *, tokenizer: str) -> DataFrame:
    """Counts before and after each document's ``edits`` (in order; each addresses the text the one before left)."""
    return trees.mapInPandas(_apply(tokenizer, True), "doc_id long, n_tokens long, n_tokens_after long, n_chars_after long, n_edits long, chars_encoded_again long")


def edited_trees(trees: DataFrame, *, tokenizer: str) -> DataFrame:
    """The trees after each document's ``edits``: write them, and the next batch of edits goes on from there."""
    return trees.mapInPandas(_apply(tokenizer, False), "doc_id long, text string, leaf_chars array<long>, leaf_tokens array<long>")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Attach an edit log (doc_id, seq, start, n_delete, insert) to its documents or trees, in order of seq. Entries without
    id are those of rows without id; rows that share an id each get all of its entries."""
    log = edits.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.col("start").cast("long").alias("start"), F.col("n_delete").cast("long").alias("n_delete"), "insert"))), lambda e: F.struct(e["start"].alias("start"), e["n_delete"].alias("n_delete"), e["insert"].alias("insert"))).alias("edits"))
    log = log.withColumnRenamed("doc_id", "_doc")
    kept = [c for c in ("doc_id", "text", "leaf_chars", "leaf_tokens") if c in docs.columns]
    return docs.select(*kept).join(log, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc")


def derived_edits(docs: DataFrame, n: int = 4) -> DataFrame:
    """Edits made from the documents: places and lengths by hash, inserted text from the document's own start."""
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    one = [F.struct(F.pmod(F.xxhash64("doc_id", F.lit(2 * k)), size + 1).alias("start"), F.pmod(F.xxhash64("doc_id", F.lit(2 * k + 1)), F.lit(24)).alias("n_delete"), F.coalesce(F.substring("text", 1 + 3 * k, 5 * k), F.lit("")).alias("insert")) for k in range(n)]
    return docs.withColumn("edits", F.array(*one))
