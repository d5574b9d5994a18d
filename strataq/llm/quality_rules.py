"""Quality rules with adaptive thresholds, by DataFrame functions only.

Fixed base rules drop texts that are too short or mostly repeat themselves. For the rest, thresholds come from the
corpus alone: each metric goes to a log-linear quantile sketch per language and source, a table of (bin, count) rows that
merges by adding counts, so partial aggregation combines it before the shuffle and a hot source costs no more than its
bins. Sketches of sources add up to those of their language, and these to the corpus's.

The fence of a sketch lies as far beyond its tail quantile as that lies beyond its median (``METRICS`` has each metric's
tail). A group takes its own fence if it has at least ``min_group`` texts, and that of its parent (source: language,
language: corpus) otherwise. An own fence of 0 (a metric that is nearly always 0 tells nothing of its spread) is that of
the parent too, and none lies above twice its parent's, so a source that is mostly junk can't clear itself. A corpus whose tail quantile is 0 has no fence for that metric. A joined filter applies each group's fences.

A bin holds integers that agree in their first ``PRECISION`` bits, so a quantile is off by less than 2**(1 - PRECISION);
the tail is taken from the top of its bin, so that no value of the tail's own bin is beyond the fence.

Edge cases: null text has no words and fails the base rules; null language or source is a group of its own; texts that
fail the base rules are in no sketch; a group without a sketch has no fences and drops nothing more; equal values at the
fence stay; repeated rows each count and each get a row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.llm.runtime import materialize

PRECISION = 6
#: Metric: its tail quantile in percent.
METRICS = {"symbol_ppm": 95, "dup_line_ppm": 99, "repeat_ppm": 99, "word_length_ppm": 95}

_WORD = r"[^\x20\x09-\x0D]+"


def _trigram_cover(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more: windows sorted by (hash, place), places with an equal
    neighbour taken, and each counted for the words that the place before it does not cover already."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def covered(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        twice = F.transform(
            F.filter(pairs, lambda x, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(pairs, i + 1)["h"] == x["h"]))),
            lambda x: x["p"],
        )
        start = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(3), p - acc["at"])).alias("n"))
        return F.aggregate(F.array_sort(twice), start, step, lambda acc: acc["n"])

    def of(hs: Column) -> Column:
        pairs = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        bound = F.element_at(F.transform(F.array(pairs), covered), 1)
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(bound)

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(F.element_at(F.transform(F.array(hashes), of), 1))


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each row's whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("t"))

    def counts(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), _trigram_cover(words).alias("n_repeat_words"))

    words = F.regexp_extract_all("t", F.lit(_WORD), F.lit(0))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(_WORD))
    of_lines = F.element_at(F.transform(F.array(lines), lambda a: F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"))), 1)
    return d.select(
        "doc_id", "lang", "source",
        F.element_at(F.transform(F.array(words), counts), 1).alias("c"),
        (F.length("t") - F.regexp_count("t", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        of_lines.alias("l"),
    ).select("doc_id", "lang", "source", "c.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "c.n_repeat_words", "l.n_lines")


def _ppm(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.expr(f"({part} * 1000000L) div {whole}")).otherwise(F.lit(0)).cast("long")


def _bin(x: Column) -> Column:
    """The least integer with the same first ``PRECISION`` bits."""
    shift = _dropped(x)
    return F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift)


def _dropped(x: Column) -> Column:
    """How many last bits a bin leaves open."""
    return F.greatest(F.length(F.bin(x)) - PRECISION, F.lit(0))


def _top(x: Column) -> Column:
    """The greatest integer of a bin given by its least."""
    return x + F.call_function("shiftleft", F.lit(1).cast("long"), _dropped(x)) - 1


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bin, n): mergeable quantile sketches of the metrics."""
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))
    flat = measured.select("lang", "source", F.explode(each).alias("e")).select("lang", "source", "e.metric", _bin(F.col("e.value")).alias("bin"))
    return flat.groupBy("lang", "source", "metric", "bin").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, *, min_group: int = 200) -> DataFrame:
    """One row for each (lang, source) with the fence of each metric, from sketches of (lang, source)."""
    # level 0: the corpus, 1: languages, 2: languages and sources
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.when(F.lit(k > 0), F.col("lang")).alias("lang"), F.when(F.lit(k > 1), F.col("source")).alias("source")) for k in range(3)))
    merged = sketch.select(F.explode(levels).alias("g"), "metric", "bin", "n").groupBy("g.level", "g.lang", "g.source", "metric", "bin").agg(F.sum("n").alias("n"))
    g = Window.partitionBy("level", "lang", "source", "metric")
    up = merged.withColumn("upto", F.sum("n").over(g.orderBy("bin"))).withColumn("all", F.sum("n").over(g))
    tail = F.element_at(F.create_map(*(F.lit(x) for kv in METRICS.items() for x in kv)), F.col("metric"))
    q = up.groupBy("level", "lang", "source", "metric").agg(
        F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("bin"))).alias("middle"),
        F.min(F.when(F.col("upto") * 100 >= F.col("all") * tail, F.col("bin"))).alias("tail"),
        F.max("all").alias("all"),
    ).withColumn("own", 2 * _top(F.col("tail")) - F.col("middle"))

    def within(parent: str) -> Column:
        near = F.least(F.coalesce(F.nullif("own", F.lit(0)), F.col(parent)), 2 * F.col(parent))
        return F.when(F.col("all") < min_group, F.col(parent)).when(F.col(parent).isNull(), F.nullif("own", F.lit(0))).otherwise(near)

    corpus = q.where("level = 0").select("metric", F.nullif("own", F.lit(0)).alias("corpus"))
    langs = q.where("level = 1").join(corpus, "metric", "left").select("metric", F.col("lang").alias("_lang"), within("corpus").alias("whole"))
    own = q.where("level = 2").alias("q").join(langs.alias("w"), (F.col("q.metric") == F.col("w.metric")) & F.col("lang").eqNullSafe(F.col("_lang")), "left")
    own = own.select("lang", "source", "q.metric", within("whole").alias("fence"))
    return own.groupBy("lang", "source").agg(*(F.max(F.when(F.col("metric") == m, F.col("fence"))).alias(f"{m}_fence") for m in METRICS))


def quality_rules(docs: DataFrame, *, min_words: int = 50, max_repeat_percent: int = 50, min_group: int = 200) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each row."""
    m = metrics(docs)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    m = m.withColumn("base_failed", failed)
    m = m.withColumns({"symbol_ppm": _ppm("n_symbols", "word_chars"), "dup_line_ppm": _ppm("n_dup_lines", "n_lines"), "repeat_ppm": _ppm("n_repeat_words", "n_words"), "word_length_ppm": _ppm("word_chars", "n_words")})
    m = materialize(m)  # a few numbers a row, written once: texts are read once
    limit = fences(sketches(m.where(~F.col("base_failed"))), min_group=min_group)
    limit = limit.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    j = m.join(limit, m["lang"].eqNullSafe(limit["_lang"]) & m["source"].eqNullSafe(limit["_source"]), "left")
    over = [F.coalesce(F.col(x) > F.col(f"{x}_fence"), F.lit(False)) for x in METRICS]
    kept = ~F.col("base_failed") & ~(over[0] | over[1] | over[2] | over[3])
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
