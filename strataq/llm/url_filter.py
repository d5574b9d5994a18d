"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Trees are trained from labelled URLs (here: those the rules decide), at most about ``max_labelled`` of them, picked by
the hash of the URL, each once, and in equal parts from both labels as far as these have them. Suffix statistics (how often a
host's last label occurs) come from all URLs. Features and verdicts are DataFrame functions and Spark's own trees.

Edge cases: a null URL or one without ``://`` has an empty host and path, no rule, and is judged by its features like
any other; a negative page_id is as good as another; repeated rows are judged alike; where no label or only one was
learned, that one (or ``allow``) is the verdict; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (domain, path prefix, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
FEATURES = ["length", "host_length", "depth", "host_depth", "digit_ratio", "other_ratio", "entropy", "n_params", "suffix_share", "path_length"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host up to /, ?, # or the end with A-Z lower-cased; path then up to ?, # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def matched(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, null where none does."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, prefix, what in reversed(longest):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(domain + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features to rows with url, host and path."""
    u = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    chars = F.filter(F.split(u, ""), lambda c: c != "")

    def bits(c: Column) -> Column:
        p = (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n
        return -p * F.log2(p)

    entropy = F.aggregate(F.transform(F.array_distinct(chars), bits), F.lit(0.0), lambda a, b: a + b)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    out = urls.withColumns({
        "length": F.length(u).cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": F.regexp_count("path", F.lit("/")).cast("double"),
        "host_depth": F.regexp_count("host", F.lit("[.]")).cast("double"),
        "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / n,
        "other_ratio": F.regexp_count(u, F.lit("[^0-9A-Za-z]")) / n,
        "entropy": entropy,
        "n_params": F.when(query == "", 0.0).otherwise(F.regexp_count(query, F.lit("&")) + 1.0),
        "suffix": F.regexp_extract("host", r"[^.]*\z", 0),
    })
    share = out.groupBy("suffix").agg(F.count(F.lit(1)).alias("of"))
    total = out.agg(F.count(F.lit(1)).alias("n_urls"))
    share = share.crossJoin(F.broadcast(total)).select("suffix", (F.col("of") / F.col("n_urls")).alias("suffix_share"))  # one row of total
    return out.join(share, "suffix")


def train(labelled: DataFrame, *, max_labelled: int = 4000, trees: int = 8, depth: int = 4):
    """A model on rows with the features and a verdict, or the only verdict there is. A URL counts once, however often
    it occurs, so the sample is as small as it says."""
    urls = labelled.select("url", "verdict").distinct()
    counts = {r["verdict"]: r["n"] for r in urls.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(counts) < 2:
        return next(iter(counts), "allow")
    place = F.pmod(F.xxhash64("url"), F.lit(1 << 40))
    half = {k: min(1.0, max_labelled / 2 / n) for k, n in counts.items()}
    part = F.when(F.col("verdict") == "block", half["block"]).otherwise(half["allow"])
    once = labelled.where(place < part * (1 << 40)).dropDuplicates(["url"])
    picked = once.select(*FEATURES, F.when(F.col("verdict") == "block", 1.0).otherwise(0.0).alias("label"))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(picked).select("features", "label")
    rows = rows.repartition(4).cache()  # at most about max_labelled short rows
    try:
        return GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, cacheNodeIds=False).fit(rows)
    finally:
        rows.unpersist()


def url_filter(pages: DataFrame, *, rules: list[tuple[str, str, str]] = RULES, max_labelled: int = 4000) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's probability of block) of each row."""
    u = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = parts(F.col("url"))
    u = u.withColumn("host", host).withColumn("path", path)
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    f = lexical(u.withColumn("rule", rule).withColumn("verdict", verdict))
    model = train(f.where(F.col("verdict").isNotNull()), max_labelled=max_labelled)
    if isinstance(model, str):
        return f.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(model)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    judged = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(f))
    own = F.when(F.col("prediction") == 1.0, F.lit("block")).otherwise(F.lit("allow"))
    from pyspark.ml.functions import vector_to_array

    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), vector_to_array("probability")[1].alias("score"))
