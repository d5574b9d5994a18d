"""Whitening of embeddings by components whose precision is mended after a cheap solve.

A vector's entries become integers, x = floor(64 * c) + 1000000. The fit list holds each distinct x vector once (a
shuffle on the whole vector, combined before it, so copies cost no more than one row a task). Of the fit list Spark sums
each dimension exactly, then the products of centred entries; only these dims x dims numbers come to the driver.

1. *Cheap solve.* Eigenvectors of the covariance in float32.
2. *Refinement.* Ogita-Aishima steps in extended precision: from R = I - X'X and S = X'AX follow eigenvalues and a
   correction X + XE, by matrix products alone; the error is squared in each step. What E leaves of R is taken out before
   the next step, as near eigenvalues would magnify it.
3. *Clusters.* Eigenvalues nearer than the residual can tell apart are not corrected against each other. The matrix is
   projected on their vectors, shifted by their mean, and this small problem is solved by itself; the next step goes on
   from there.

Edge cases: vectors that are null, hold null or non-finite entries or any beyond 2**54 in size are dropped, and so are
those of another length than most of the fit list has (the longer of two); a null id is an id like others; copies are in
the fit list once and each get their rows; a component needs an eigenvalue above ``RANK`` of the largest, so constant
dimensions, a single vector or fewer vectors than dimensions give fewer components (or none, then no rows); other columns
are ignored; an empty table gives no rows. ``deviation`` is null where the exact number is beyond a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.runtime import materialize, small_batches

SCALE, SHIFT = 64, 1_000_000
#: Least eigenvalue of a component, as a share of the largest: below, sums in doubles no longer tell it from zero.
RANK = 1e-11
STEPS = 24
_WIDE = np.longdouble
_EPS = np.finfo(_WIDE).eps


def _clusters(values: np.ndarray, least: float) -> list[np.ndarray]:
    """Runs of two or more values, each no further than ``least`` from its neighbour."""
    order = np.argsort(values)
    runs = np.split(order, np.flatnonzero(np.diff(values[order]) > least) + 1)
    return [r for r in runs if len(r) > 1]


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Columns that are nearly orthonormal, made so by products alone; what is left is squared each time."""
    one = np.eye(x.shape[1], dtype=x.dtype)
    for _ in range(4):
        x = x + x @ (one - x.T @ x) / 2
    return x


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of a symmetric matrix in extended precision, from approximate eigenvectors."""
    a, x = a.astype(_WIDE), x.astype(_WIDE)
    one, size = np.eye(len(a), dtype=_WIDE), np.sqrt((a * a).sum())
    for _ in range(STEPS):
        r = one - x.T @ x
        s = x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        apart = 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > apart
        step = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
        x = _orthonormal(x + x @ step)
        left = np.abs(step).max()
        for c in _clusters(values, apart):
            own = x[:, c]
            small = own.T @ a @ own
            small = small - np.eye(len(c), dtype=_WIDE) * (np.trace(small) / len(c))
            if np.abs(small - np.diag(np.diag(small))).max() > 16 * _EPS * size:  # else solved, or equal eigenvalues, where any basis will do
                inner = np.linalg.eigh((small / np.abs(small).max()).astype(np.float64))[1]
                x[:, c] = own @ _orthonormal(inner.astype(_WIDE))
                left = 1  # the inner solve is right to doubles of its own size: another step
        if left < 64 * _EPS:
            break
    values = np.diag(x.T @ a @ x) / (x * x).sum(0)
    return values, x


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, in double precision."""
    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    size = float(np.abs(a).max()) or 1.0
    values, x = refine(a / size, np.linalg.eigh((a / size).astype(np.float32))[1])
    order = np.argsort(-values, kind="stable")
    x = (x / np.sqrt((x * x).sum(0)))[:, order].astype(np.float64)
    x = x * np.where(x[np.abs(x).argmax(0), np.arange(len(a))] < 0, -1.0, 1.0)  # the largest entry is positive
    return (values[order] * size).astype(np.float64), x


@dataclass
class Whitening:
    """What a fit list tells: its size and exact sums, and the components found."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def dims(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n as doubles, from integers: the mean itself is never rounded."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([s % self.n for s in self.sums], np.float64)
        return (x - whole) - part / self.n

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n * x - S)**2, exact."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = [s % self.n for s in self.sums]
        y = x - whole
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        kind = np.int64 if most * most * max(1, self.dims) < 1 << 62 else object
        d = self.n * y.astype(kind) - np.array(part, kind)
        return (d * d).sum(1).tolist()

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def integers(df: DataFrame, *, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector can be used."""
    c = F.col(f"`{column}`").cast("array<double>")
    fits = F.forall(c, lambda v: F.coalesce(F.abs(v) < 2.0**54, F.lit(False)))  # NaN counts as larger than all else
    x = F.transform("c", lambda v: F.floor(v * SCALE) + SHIFT)
    return df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), c.alias("c"), fits.alias("fits")).where("fits").select("vec_id", x.alias("x"))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    col = b.column("x")
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each dimension the sums of high and low parts, which stay far from a long's end."""
    n, high, low = 0, 0, 0
    for b in batches:
        if len(b):
            x = _matrix(b)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
    if n:
        d = len(high)
        yield pa.RecordBatch.from_pydict({"i": np.arange(d), "n": np.full(d, n), "high": high, "low": low})


def _products(model: Whitening, whitened: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                c = model.project(_matrix(b)) if whitened else model.centred(_matrix(b))
                total = c.T @ c if total is None else total + c.T @ c
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"i": i, "j": j, "v": total[i, j]})

    return run


def _covariance(fit_list: DataFrame, model: Whitening, k: int, *, whitened: bool = False) -> np.ndarray:
    """Covariance over the fit list (of whitened rows, if asked for): k * (k + 1) / 2 sums come to the driver."""
    sums = fit_list.mapInArrow(_products(model, whitened), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((k, k))
    for r in sums.collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"] / model.n
    return out


def fit(vectors: DataFrame, *, components: int = 16) -> Whitening | None:
    """Whitening of the distinct x of ``vectors``; none where there are no vectors."""
    small_batches(vectors.sparkSession)
    distinct = materialize(vectors.select("x").distinct())
    size = distinct.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if size is None or not size["size"]:
        return None
    fit_list = distinct.where(F.size("x") == size["size"])
    sums = fit_list.mapInArrow(_sums, "i long, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("i").collect()
    model = Whitening(sums[0]["n"], [(r["high"] << 32) + r["low"] for r in sums], np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    covariance = _covariance(fit_list, model, model.dims)
    values, x = eigen(covariance)
    keep = int((values[:components] > max(0.0, values[0]) * RANK).sum())
    model.values, model.vectors, model.trace = values[:keep], x[:, :keep], float(np.trace(covariance))
    if keep:
        model.identity_error = float(np.abs(_covariance(fit_list, model, keep, whitened=True) - np.eye(keep)).max())
    return model


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """A row for each of ``vectors`` (vec_id, x) and component."""
    small_batches(vectors.sparkSession)
    k = len(model.values)
    explained = model.values / model.trace if k else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = len(b)
            if not m or not k:
                continue
            x = _matrix(b)
            exact = [d if d < 1 << 63 else None for d in model.deviation(x)]
            rows = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(exact, pa.int64()).take(pa.array(rows)), pa.array(model.project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.where(F.size("x") == model.dims).mapInArrow(run, OUT)


def dense(whitened: DataFrame) -> DataFrame:
    """(vec_id, whitened array) from rows of components, for ids that name one row each."""
    return whitened.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "whitened"))), lambda e: e["whitened"]).alias("whitened"))


def embedding_whitening(df: DataFrame, *, components: int = 16, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of the usable rows of ``df``."""
    x = integers(df, key=key, column=column)
    model = fit(x, components=components)
    return df.sparkSession.createDataFrame([], OUT) if model is None else whiten(x, model)
