"""Search queries over documents as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.functions.text import suffix, tokens
from strataq.operators import retrieval as S
from strataq.operators.index import Index
from strataq.operators.nearest import nearest
from strataq.operators.ranking import top_per, with_total
from strataq.plans.registry import query
from strataq.sources.lists import read_sorted, write_sorted
from strataq.sources.session import scratch
from strataq.sources.tables import Tables, sql

QUERY = "the thin reason of entire den"
_TOK = r"list_filter(regexp_extract_all(lower(replace(regexp_replace({x}, '([a-z])([A-Z])', '\1 \2', 'g'), '_', ' ')), '[a-z0-9]+'), lambda t: length(t) > 1)"
_INDEX = ", docs AS (SELECT * FROM (SELECT ordinal, path, " + _TOK.format(x="content") + """ AS tokens FROM files) WHERE len(tokens) > 0),
post AS (SELECT ordinal, len(tokens) AS length, unnest(tokens) AS term FROM docs), tf AS (SELECT term, ordinal, count(*) AS tf, max(length) AS length FROM post GROUP BY 1, 2),
stat AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avg_length FROM docs),
raw AS (SELECT term, df, ln(n_docs - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), stat),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(""" + _TOK.format(x="text") + """) AS term FROM benchmark) GROUP BY 1, 2),
score AS (SELECT query_id, ordinal, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg_length))) AS score FROM tf JOIN q USING (term) JOIN idf USING (term), stat GROUP BY 1, 2)"""


def _queries(t: Tables) -> DataFrame:
    """Each benchmark item is a query."""
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


@query("tokenize", sql("files", f"SELECT path, len(k)::BIGINT AS n_tokens, md5(array_to_string(k, ' ')) AS digest FROM (SELECT path, {_TOK.format(x='content')} AS k FROM files)"))
def tokenize(t: Tables) -> DataFrame:
    k = t.files().select("path", tokens(F.col("content")).alias("k"))
    return k.select("path", F.size("k").cast("long").alias("n_tokens"), F.md5(F.array_join("k", " ")).alias("digest"))


@query("bm25_corpus_stats", sql("files", _INDEX + " SELECT n_docs, round(avg_length, 4) AS avg_length, (SELECT count(*) FROM raw) AS vocabulary FROM stat"))
def bm25_corpus_stats(t: Tables) -> DataFrame:
    x = Index.of(t.sf_dir, t.files_and_origin())
    return with_total(x.statistics, x.postings.agg(F.countDistinct("term").alias("vocabulary"))).withColumn("avg_length", F.round("avg_length", 4))


@query("bm25_idf", sql("files", _INDEX + " SELECT term, df, round(idf, 6) AS idf FROM idf"))
def bm25_idf(t: Tables) -> DataFrame:
    return Index.of(t.sf_dir, t.files_and_origin()).idf().withColumn("idf", F.round("idf", 6))


@query("bm25_index", sql("files", _INDEX + " SELECT term, ordinal, tf FROM tf"))
def bm25_index(t: Tables) -> DataFrame:
    return Index.of(t.sf_dir, t.files_and_origin()).postings.select("term", "ordinal", "tf")


@query("bm25_scores", sql("files", _INDEX + " SELECT query_id, ordinal, round(score, 4) AS score FROM score"))
def bm25_scores(t: Tables) -> DataFrame:
    return Index.of(t.sf_dir, t.files_and_origin()).scores(_queries(t)).withColumn("score", F.round("score", 4))


@query("bm25_search", sql("files", _INDEX + """, r AS (SELECT query_id, ordinal, round_even(score, 4) AS score FROM score WHERE score > 0)
SELECT query_id, ordinal, path, r.score, (row_number() OVER (PARTITION BY query_id ORDER BY r.score DESC, ordinal))::INT AS rank FROM r JOIN docs USING (ordinal) QUALIFY rank <= 20"""))
def bm25_search(t: Tables) -> DataFrame:
    return Index.of(t.sf_dir, t.files_and_origin()).search(_queries(t)).select("query_id", "ordinal", "path", "score", "rank")


_LINES = ", lines AS (SELECT path, unnest(range(1, len(l) + 1)) AS line_number, unnest(l) AS line FROM (SELECT path, string_split(content, chr(10)) AS l FROM files))"


@query("matching_lines", sql("files", _LINES + f""", m AS (SELECT path, line_number, line, list_sort(list_distinct(list_intersect({_TOK.format(x='line')}, {_TOK.format(x=f"'{QUERY}'")}))) AS s FROM lines)
SELECT path, line_number, left(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 200) AS text, array_to_string(s, ' ') AS matched FROM m WHERE len(s) > 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_number) <= 3"""))
def matching_lines(t: Tables) -> DataFrame:
    return S.matching_lines(t.files(), QUERY)


@query("token_intersect", sql("files", _LINES + f" SELECT path, count(*) AS n_lines FROM lines WHERE len(list_intersect({_TOK.format(x='line')}, {_TOK.format(x=f"'{QUERY}'")})) > 0 GROUP BY 1"))
def token_intersect(t: Tables) -> DataFrame:
    hit = F.arrays_overlap(tokens(F.col("line")), tokens(F.lit(QUERY)))
    return S.lines(t.files()).where(hit).groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"))


@query("rg_search", sql("files", _LINES + " SELECT path, line_number, line FROM lines WHERE regexp_matches(line, 'tion[,.]') QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_number) <= 5"))
def rg_search(t: Tables) -> DataFrame:
    return S.search_lines(t.files(), "tion[,.]", most=5)


@query("rg_search_glob", sql("files", _LINES + " SELECT path, line_number, line FROM lines WHERE path LIKE 'src1%/en/%' AND regexp_matches(line, 'th[a-z]+ing') QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_number) <= 100"))
def rg_search_glob(t: Tables) -> DataFrame:
    return S.search_lines(t.files().where("path LIKE 'src1%/en/%'"), "th[a-z]+ing")


@query("rg_count", sql("files", _LINES + " SELECT path, count(*) AS count FROM lines WHERE regexp_matches(line, '[0-9]{3}') GROUP BY 1"))
def rg_count(t: Tables) -> DataFrame:
    return S.count_lines(t.files(), "[0-9]{3}")


@query("rg_search_context", sql("files", """, l AS (SELECT path, string_split(content, chr(10)) AS l FROM files), h AS (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM l)
SELECT path, i::BIGINT AS line_number, l[i] AS line, array_to_string(l[greatest(1, i - 2):i - 1], chr(10)) AS before, array_to_string(l[i + 1:i + 2], chr(10)) AS after FROM h WHERE regexp_matches(l[i], '[0-9]{3}') QUALIFY row_number() OVER (PARTITION BY path ORDER BY i) <= 100"""))
def rg_search_context(t: Tables) -> DataFrame:
    return S.search_context(t.files(), "[0-9]{3}", context=2)


@query("read_file_bounded", sql("files", """, l AS (SELECT path, string_split(content, chr(10))[2:4] AS l FROM files)
SELECT path, array_to_string(list_transform(l, lambda x, i: concat(lpad((i + 1)::VARCHAR, 6, ' '), '| ', regexp_replace(x, '\\s+$', ''))), chr(10)) AS body, len(l)::BIGINT AS lines_read, len(l) >= 3 AS truncated FROM l"""))
def read_file_bounded(t: Tables) -> DataFrame:
    return S.read_bounded(t.files(), most=3, start=2)


@query("volume_stats", sql("files", "SELECT count(*) AS file_count, sum(length(content) - length(replace(content, chr(10), '')))::BIGINT AS total_lines, floor(sum(length(content) - length(replace(content, chr(10), ''))) * 2.5)::BIGINT AS estimated_tokens FROM files"))
def volume_stats(t: Tables) -> DataFrame:
    n = F.sum(F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))))
    return t.files().agg(F.count(F.lit(1)).alias("file_count"), n.alias("total_lines"), F.floor(n * 2.5).alias("estimated_tokens"))


@query("write_file_list", sql("paths", "SELECT DISTINCT path FROM paths"))
def write_file_list(t: Tables) -> DataFrame:
    """Written as a sorted list and read back."""
    folder = scratch(t.spark)
    write_sorted(t.paths(), F.col("path"), folder)
    return t.spark.read.text(folder).withColumnRenamed("value", "path")


@query("sorted_file_list", sql("paths", "SELECT row_number() OVER (ORDER BY path) AS place, path, (SELECT count(DISTINCT path) FROM paths) AS file_count FROM (SELECT DISTINCT path FROM paths)"))
def sorted_file_list(t: Tables) -> DataFrame:
    """The list's lines in the order of its files, and how many were written."""
    folder = scratch(t.spark)
    n = write_sorted(t.paths(), F.col("path"), folder)
    return read_sorted(t.spark, folder).select("place", F.col("value").alias("path"), F.lit(n).cast("long").alias("file_count"))


_EXT = "lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))"


@query("detect_languages", sql("paths", f"SELECT CASE {_EXT} WHEN '.py' THEN 'py' WHEN '.rs' THEN 'rust' WHEN '.go' THEN 'go' WHEN '.java' THEN 'java' ELSE 'ts' END AS lang, count(*) AS files FROM paths WHERE {_EXT} IN ('.py', '.ts', '.tsx', '.js', '.jsx', '.rs', '.go', '.java') GROUP BY 1"))
def detect_languages(t: Tables) -> DataFrame:
    # fixed values: extensions and their languages
    known = [(".py", "py"), (".ts", "ts"), (".tsx", "ts"), (".js", "ts"), (".jsx", "ts"), (".rs", "rust"), (".go", "go"), (".java", "java")]
    langs = F.broadcast(t.literal("ext string, lang string", known))  # eight rows
    return t.paths().select(suffix(F.col("path")).alias("ext")).join(langs, "ext").groupBy("lang").agg(F.count(F.lit(1)).alias("files"))


#: Folders that a manifest leaves out.
SKIPPED = [".git", "node_modules", "__pycache__", ".venv", "venv", ".tox", "dist", "build"]
#: Suffixes that text search leaves out.
BINARY = [".png", ".jpg", ".gif", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".pdf", ".zip", ".gz", ".tar"]


@query("file_manifest", sql("tree", f"SELECT p_partkey, path FROM tree WHERE NOT list_has_any(string_split(path, '/'), {SKIPPED})"))
def file_manifest(t: Tables) -> DataFrame:
    return t.tree().where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))


@query("page_manifest", f"SELECT page_id, path FROM (SELECT page_id, regexp_extract(url, '://(.*)$', 1) AS path FROM pages) WHERE NOT list_has_any(string_split(path, '/'), {SKIPPED})")
def page_manifest(t: Tables) -> DataFrame:
    p = t.pages.select("page_id", F.regexp_extract("url", "://(.*)$", 1).alias("path"))
    return p.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))


@query("skip_filter", sql("tree", f"SELECT path, len(list_intersect(string_split(path, '/')[:-2], {SKIPPED})) > 0 OR {_EXT} IN {tuple(BINARY)} AS skipped FROM tree"))
def skip_filter(t: Tables) -> DataFrame:
    parts = F.split("path", "/")
    skip = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, SKIPPED))) | suffix(F.col("path")).isin(*BINARY)
    return t.tree().select("path", skip.alias("skipped"))


@query("embedding_topk", """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i]::DOUBLE * embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 5) AS similarity FROM q, embeddings WHERE vec_id <> query_id)
SELECT query_id, vec_id, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 5""")
def embedding_topk(t: Tables) -> DataFrame:
    """Cosine top-5 of a stated query set (ids divisible by 50) against all rows."""
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return nearest(e, e.where("id % 50 = 0"), 5)
