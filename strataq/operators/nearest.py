"""The vectors most alike each of a set of queries, by exact cosine similarity over all vectors.

Vectors and queries are dealt into blocks of bounded size, and a task compares one block of each by matrix products, of
which it keeps only what can still be among the best. A product's sums differ from those taken in order by rounding alone,
so what is near a query's last place is summed again in order before it is rounded and ranked. Work grows with the product
of both tables, a task's memory with neither.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.operators.ranking import top_per
from strataq.sources.session import ship

#: Rows of a block of vectors and of one of queries; queries that a product takes at once.
VECTORS, QUERIES, SLICE = 16_384, 16_384, 256
#: Similarities are rounded to so many places before they are ranked.
PLACES = 5


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _firsts(ids: np.ndarray, e: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` smallest ids of each distinct vector, in order of ids: others come after these in any ranking."""
    order = np.argsort(ids, kind="stable")
    _, group = np.unique(e[order], axis=0, return_inverse=True)
    by = np.argsort(group, kind="stable")
    at = np.arange(len(by)) - np.searchsorted(group[by], group[by])
    return order[np.sort(by[at < n])]


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the first entry on."""
    s = np.zeros(len(a))
    for k in range(a.shape[1]):
        s += a[:, k] * b[:, k]
    return s


def _best(top: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block of each: for each query the vectors that can be among the best ``top``."""

    def block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = table.column(1).combine_chunks()
        e = e.flatten().to_numpy(zero_copy_only=False).reshape(len(e), -1)
        return table.column(0).to_numpy(), e, table.column(2).to_numpy()

    def f(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(vectors) and len(queries):
            (v, e, n), (q, p, m) = block(vectors), block(queries)
            kept = _firsts(v, e, top + 1)  # one more, as a query is no answer to itself
            v, e, n = v[kept], e[kept], n[kept]
            unit = np.ascontiguousarray((e / n[:, None]).T)
            for i in range(0, len(q), SLICE):
                s = (p[i : i + SLICE] / m[i : i + SLICE, None]) @ unit
                s[q[i : i + SLICE, None] == v[None, :]] = -np.inf
                last = np.partition(s, -min(top, len(v)), axis=1)[:, -min(top, len(v))]
                # equal when rounded, or apart by the sums' own rounding
                a, b = np.nonzero((s >= last[:, None] - 1.001 * 10.0**-PLACES) & (s > -np.inf))
                exact = _in_order(e[b], p[i + a]) / (n[b] * m[i + a])
                found.append((q[i + a], v[b], exact))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": cols[0].astype(np.int64), "vec_id": cols[1].astype(np.int64), "similarity": cols[2]})

    return f


def nearest(vectors: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """(query_id, vec_id, similarity) of the best ``top`` other vectors of each query, of (id, e) with arrays of doubles; ties
    go to smaller ids. A vector that is null, holds what is no finite number, is all zeros or has another length than the
    first by id has no similarity to a query, or one that is no number: these few meet all others pair by pair."""
    ship(vectors.sparkSession)
    size = vectors.where(F.size("e") > 0).agg(F.min_by(F.size("e"), "id").alias("size")).first()["size"] or 0
    n = F.sqrt(dot("e", "e"))
    whole = F.coalesce((F.size("e") == size) & F.forall("e", lambda x: x.isNotNull() & (F.abs(x) < 1e100)) & (F.aggregate("e", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x))) > 1e-100), F.lit(False))
    v, q = (df.select("id", "e", n.alias("n"), whole.alias("whole")) for df in (vectors, queries))
    rows = {r["of"]: r["n"] for r in v.select(F.lit("v").alias("of")).unionByName(q.select(F.lit("q").alias("of"))).groupBy("of").agg(F.count(F.lit(1)).alias("n")).collect()}  # two numbers
    nv, nq = -(-rows.get("v", 0) // VECTORS) or 1, -(-rows.get("q", 0) // QUERIES) or 1
    deal = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = v.where("whole").select("id", "e", "n", deal(nv).alias("vb"), every(nq).alias("qb"))
    right = q.where("whole").select("id", "e", "n", deal(nq).alias("of"), every(nv).alias("to")).toDF("query_id", "q", "m", "of", "to")
    met = left.groupBy("vb", "qb").cogroup(right.groupBy("to", "of")).applyInArrow(_best(top), "query_id long, vec_id long, similarity double")
    a, b = v.toDF("vec_id", "e", "n", "v_whole"), q.toDF("query_id", "q", "m", "q_whole")
    both = F.col("n") * F.col("m")
    pair = F.when(both == 0, float("nan")).otherwise(F.try_divide(dot("e", "q"), both)).alias("similarity")
    odd = a.where("NOT v_whole").join(b, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", pair)
    odd = odd.unionByName(b.where("NOT q_whole").join(a.where("v_whole"), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", pair))
    s = met.unionByName(odd).withColumn("similarity", F.round("similarity", PLACES))
    return top_per(s, ["query_id"], top, F.desc("similarity"), F.asc("vec_id")).select("query_id", "vec_id", "similarity")
