"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased and all else is a blank; n-grams of one to three characters are hashed to ``2**BITS`` features.
Document frequencies come from all labelled training documents. Weights are fitted by follow-the-regularised-leader
with elastic-net penalties on a bounded sample, ``per_language`` training documents of each language that the hash of
their ids and texts picks (equal rows once; fewer where languages are many, ``max_texts`` in all), of at most
``max_languages`` languages, the most frequent ones; of a sampled text its ``PER_TEXT`` most frequent features count. So the
driver receives at most 12 bytes x PER_TEXT x about max_texts, some 300 MB, whatever the corpus, and document frequencies
as one row a feature. A further share of the sample fits the temperature. Prediction reads whole texts.

Edge cases: a text that is null or has no letter (by Unicode category, in all planes) is ``und`` with score 0, and so is
every text where nothing could be learned; a null doc_id counts as training; rows that share a doc_id are predicted
separately, equal rows alike; of equally probable languages the first in order of their names is taken; a text's features
are summed over its whole length, of any length; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.runtime import materialize, small_batches

BITS = 15
SIZE = 1 << BITS
ORDERS = 3
#: Features of a sampled text that give weights, the most frequent ones.
PER_TEXT = 2048
_POINTS = 0x110000


def _letters() -> np.ndarray:
    """For each code point its lower case, or a blank where it is no letter."""
    out = np.full(_POINTS, 32, np.uint32)
    for c in range(_POINTS):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LOWER = _letters()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of a whole text; none where it has no letter."""
    c = _LOWER[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    blank = c == 32
    if blank.all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    c = np.concatenate([[np.uint32(32)], c[keep], [np.uint32(32)]]).astype(np.uint32)
    total = np.zeros(SIZE, np.int64)
    h = c * np.uint32(0x9E3779B1)
    for k in range(ORDERS):
        if k:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[k:] * np.uint32(0xC2B2AE35) + np.uint32(k)
        total += np.bincount((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS), minlength=SIZE)
    i = np.flatnonzero(total)
    return i, total[i]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = (1 + np.log(n)) * self.idf[i]
        return v / max(float(np.sqrt((v * v).sum())), 1e-12)

    def logits(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.vector(i, n) @ self.weights[i] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        i, n = features(text) if isinstance(text, str) else (np.zeros(0), None)
        if not len(i) or not self.languages:
            return "und", 0.0
        z = self.logits(i, n) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def ftrl(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]], *, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.002) -> None:
    """Follow-the-regularised-leader (proximal), one row at a time; sets the model's weights and bias."""
    k = len(model.languages)
    z, n = np.zeros((SIZE + 1, k)), np.zeros((SIZE + 1, k))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for y, i, count in rows:
            i, x = np.append(i, SIZE), np.append(model.vector(i, count), 1.0)
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            more = ni + g * g
            z[i] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[i] = more
    w = weights(z, n)
    model.weights, model.bias = w[:SIZE], w[SIZE]


def calibrate(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """The temperature with the least log loss on rows that the weights have not seen."""
    if not rows:
        return
    z = np.stack([model.logits(i, n) for _, i, n in rows])
    y = np.array([r[0] for r in rows])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    grid = np.exp(np.linspace(np.log(0.2), np.log(5), 80))
    model.temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])


_SAMPLED = pa.schema([("lang", pa.string()), ("pick", pa.int64()), ("feature", pa.binary()), ("n", pa.binary()), ("f", pa.int64()), ("df", pa.int64())])
#: Of document frequencies, the row that counts documents.
_ALL = -1


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's document frequencies, a row a feature, and the counts of its texts in the sample."""
    df, docs, seen = np.zeros(SIZE, np.int64), 0, set()
    for b in batches:
        out: dict[str, list] = {"lang": [], "pick": [], "feature": [], "n": []}
        for text, lang, pick in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), b.column("pick").to_pylist(), strict=True):
            i, n = features(text)
            if not len(i):
                continue
            df[i] += 1
            docs += 1
            if pick is not None and (lang, pick) not in seen:
                seen.add((lang, pick))
                if len(i) > PER_TEXT:
                    most = np.sort(np.argsort(-n, kind="stable")[:PER_TEXT])
                    i, n = i[most], n[most]
                out["lang"].append(lang), out["pick"].append(pick)
                out["feature"].append(i.astype(np.uint32).tobytes()), out["n"].append(n.tobytes())
        if m := len(out["lang"]):
            yield pa.RecordBatch.from_pydict(out | {"f": [None] * m, "df": [None] * m}, schema=_SAMPLED)
    if docs:
        i = np.append(np.flatnonzero(df), _ALL)
        none = [None] * len(i)
        yield pa.RecordBatch.from_pydict({"lang": none, "pick": none, "feature": none, "n": none, "f": i, "df": np.append(df[i[:-1]], docs)}, schema=_SAMPLED)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4, F.lit(0)) == 2


def train(docs: DataFrame, *, per_language: int = 600, max_languages: int = 200, max_texts: int = 12_000, seed: int = 0) -> Model:
    """Fit on rows of ``docs`` (doc_id, text, lang), whose fold is left out; at most about ``per_language`` of each of
    ``max_languages`` languages, ``max_texts`` in all, give weights and temperature; all rows of these languages give
    document frequencies."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 40))
    # equal rows share a place, so a share of the distinct places is taken: a language of copies is not left out
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(place).alias("of"))
    sizes = materialize(sizes.orderBy(F.desc("n"), "lang").limit(max_languages).drop("n"))
    share = min(per_language, max_texts // max(1, sizes.count()))
    picked = known.join(F.broadcast(sizes), "lang").withColumn("pick", F.when(place < F.lit(float(share)) / F.col("of") * F.lit(float(1 << 40)), place))
    found = materialize(picked.select("text", "lang", "pick").mapInArrow(_statistics, "lang string, pick long, feature binary, n binary, f long, df long"))
    df, total = np.zeros(SIZE, np.int64), 0
    for r in found.where("f IS NOT NULL").groupBy("f").agg(F.sum("df").alias("df")).collect():  # a row a feature
        if r["f"] == _ALL:
            total = r["df"]
        else:
            df[r["f"]] = r["df"]
    once = found.where("pick IS NOT NULL").select("lang", "pick", "feature", "n").dropDuplicates(["lang", "pick"])
    sample = [(r["pick"], r["lang"], np.frombuffer(r["feature"], np.uint32).astype(np.int64), np.frombuffer(r["n"], np.int64)) for r in once.collect()]
    sample.sort(key=lambda r: (r[0], r[1]))
    languages = sorted({r[1] for r in sample})
    model = Model(languages, np.log((1 + total) / (1 + df)) + 1, np.zeros((SIZE, len(languages))), np.zeros(len(languages)))
    if languages:
        rows = [(languages.index(lang), i, n) for _, lang, i, n in sorted(sample, key=lambda r: (r[0] * 0x9E3779B97F4A7C15 % 2**64, r[1]))]
        cut = max(1, len(rows) * 4 // 5)
        ftrl(model, rows[:cut])
        calibrate(model, rows[cut:])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score; only the text is looked at."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features x languages, whatever the corpus

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for column in texts:
            yield pd.DataFrame([m.predict(t) for t in column], columns=["lang_pred", "score"])

    judged = docs.select("*", judge.asNondeterministic()(F.col("text").cast("string")).alias("_judged"))
    return judged.select(*(F.col(f"`{c}`") for c in docs.columns), "_judged.lang_pred", "_judged.score")


def identify(docs: DataFrame, *, per_language: int = 600) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row."""
    model = train(docs, per_language=per_language)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return predict(d, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, *, min_score: float = 0.5, per_language: int = 600) -> DataFrame:
    """``docs`` without those that have no language, or none with at least ``min_score``."""
    model = train(docs, per_language=per_language)
    d = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return predict(d, model).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select("row.*")
