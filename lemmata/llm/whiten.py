"""Whitening of embeddings by matrix-free block subspace iteration.

A vector's entries become whole numbers x = floor(64 c) + 1,000,000. The covariance V of the distinct
vectors is never formed: each pass over them computes Xᵀ(XQ) on centred rows for a thin block Q, and
the driver does QR and Rayleigh-Ritz on matrices of d rows. The blocks of earlier passes stay in the
subspace (the span of Q, VQ, V²Q ...), so flat spectra need few passes; past `HELD` blocks only the best
directions are carried on. The passes end when the residuals |Vy - ey| of all k pairs, from a last
pass over the pairs themselves, are at most `EXACT` of the largest eigenvalue.

Sums are exact whole numbers, and rows are centred as (n x - S) / n from whole numbers, so the
offset costs no digits. What a pass brings to the driver is d rows of its block, summed by Spark.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are dropped, as
are vectors of another length than the commonest (of equally common ones the longest). A null id is kept; repeated
rows are each returned, and count once in the fit. Entries beyond 2^50 count as 2^50; a deviation that does not
fit a long is null. Directions of at most `FLAT` of the trace are no components, so equal vectors,
or an empty table, give no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.llm import _graph

SCALE, SHIFT, LIMIT = 64, 1_000_000, float(1 << 56)
#: residual at which a pair is certified, share of the trace below which a direction is flat
EXACT, FLAT = 1e-12, 1e-10
#: blocks that the subspace holds before it is cut back, and passes after which the fit gives up
HELD, PASSES = 8, 300
LOW = 30


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """Rows (vec_id, x) of the vectors that take part, and their length (0 without any)."""
    at = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("size(v) > 0")
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    x = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-LIMIT)), F.lit(LIMIT))) + F.lit(SHIFT))
    rows = _graph.cut(at.where(~odd).select("vec_id", x.alias("x")))
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 0
    return rows.where(F.size("x") == d), d


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _add_up(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """A task's sums by dimension, in two halves that stay within a long."""
    high, low, n = np.zeros(d, np.int64), np.zeros(d, np.int64), 0
    for b in batches:
        x = _matrix(b.column(0), d)
        high, low, n = high + (x >> LOW).sum(0), low + (x & ((1 << LOW) - 1)).sum(0), n + len(x)
    yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(high), pa.array(low), pa.array([n] * d, pa.int64())], ["at", "high", "low", "n"])


def _centre(x: np.ndarray, n: int, s: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n x - S as whole numbers, and the same over n."""
    most = n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, s))
    d = x * n - np.array(s) if most < 1 << 62 else x.astype(object) * n - np.array(s, object)
    return d, (d / n).astype(np.float64)


def _cells(z: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(z.size)), pa.array(z.ravel())], ["cell", "value"])


def _product(batches: Iterator[pa.RecordBatch], n: int, s: list[int], q: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's share of Xᵀ(XQ), and below it of the squares of X."""
    z = np.zeros((q.shape[0] + 1, q.shape[1]))
    for b in batches:
        c = _centre(_matrix(b.column(0), len(q)), n, s)[1]
        z[:-1] += c.T @ (c @ q)
        z[-1, 0] += np.einsum("ij,ij", c, c)
    yield _cells(z)


def _second(batches: Iterator[pa.RecordBatch], n: int, s: list[int], w: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's share of YᵀY for the whitened rows Y, and below it of the sums of Y."""
    z = np.zeros((w.shape[1] + 1, w.shape[1]))
    for b in batches:
        y = _centre(_matrix(b.column(0), len(w)), n, s)[1] @ w
        z[:-1] += y.T @ y
        z[-1] += y.sum(0)
    yield _cells(z)


def _summed(fit: DataFrame, task: Callable, shape: tuple[int, int]) -> np.ndarray:
    """The tasks' matrices, added up by cell."""
    z = np.zeros(shape[0] * shape[1])
    for r in fit.mapInArrow(task, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        z[r["cell"]] = r["value"]
    return z.reshape(shape)


def _fresh(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal block of `block`'s directions outside the basis; spent ones give way to random ones."""
    block = block[:, : basis.shape[0] - basis.shape[1]]
    size = np.linalg.norm(block, axis=0)
    block = np.where(size > 0, block / np.where(size > 0, size, 1), rng.standard_normal(block.shape))
    for _ in range(3):
        block = block - basis @ (basis.T @ block)
        q, r = np.linalg.qr(block)
        weak = np.abs(np.diag(r)) < 1e-8
        block = np.where(weak, rng.standard_normal(q.shape), q)
    return np.linalg.qr(block - basis @ (basis.T @ block))[0]


def leading_pairs(times: Callable[[np.ndarray], np.ndarray], d: int, k: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The k leading eigenpairs of the symmetric matrix behind `times`: values, vectors, the largest
    residual as a part of the largest value, and the passes taken."""
    rng = np.random.default_rng(7)
    k, width = min(k, d), min(d, 2 * k)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    block, certain, passes = np.linalg.qr(rng.standard_normal((d, width)))[0], False, 0
    while passes < PASSES:
        passes += 1
        basis, image = np.hstack([basis, block]), np.hstack([image, times(block)])
        t = basis.T @ image
        e, turn = np.linalg.eigh((t + t.T) / 2)
        e, turn = e[::-1], turn[:, ::-1]
        best = turn[:, : min(width, len(e))]
        ritz, moved = basis @ best, image @ best
        off = moved - ritz * e[: best.shape[1]]
        error = float(np.linalg.norm(off[:, :k], axis=0).max() / max(e[0], np.finfo(float).tiny))
        if error <= EXACT or basis.shape[1] == d:
            if certain:
                return e[:k], ritz[:, :k], error, passes
            # the pairs themselves are the next pass's block, so the residuals are of V and not of the recurrence
            basis, image, block, certain = np.zeros((d, 0)), np.zeros((d, 0)), np.linalg.qr(ritz)[0], True
            continue
        certain = False
        if basis.shape[1] >= HELD * width:
            basis, r = np.linalg.qr(ritz)
            image = np.linalg.solve(r.T, moved.T).T
        block = _fresh(off, basis, rng)
    raise RuntimeError(f"the residuals are still {error:g} of the largest eigenvalue after {PASSES} passes")


def _rows(batches: Iterator[pa.RecordBatch], n: int, s: list[int], w: np.ndarray, explained: np.ndarray, error: float) -> Iterator[pa.RecordBatch]:
    k = w.shape[1]
    for b in batches:
        d, c = _centre(_matrix(b.column(1), len(w)), n, s)
        if len(s) * int(np.abs(d).max(initial=0)) ** 2 < 1 << 63:
            deviation = np.einsum("ij,ij->i", d, d).astype(np.int64).tolist()
        else:
            deviation = [x if x < 1 << 63 else None for x in (int(sum(int(y) ** 2 for y in row)) for row in d)]
        of = np.repeat(np.arange(len(c)), k)
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0).take(pa.array(of)),
                pa.array(np.tile(np.arange(1, k + 1), len(c)), pa.int32()),
                pa.array(np.full(len(of), n, np.int64)),
                pa.array(deviation, pa.int64()).take(pa.array(of)),
                pa.array((c @ w).ravel()),
                pa.array(np.tile(explained, len(c))),
                pa.array(np.full(len(of), error)),
            ],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def whiten(vectors: DataFrame, k: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row that takes part and component up to k: vec_id, component, n, deviation, whitened,
    explained and identity_error. Components are numbered by falling eigenvalue."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = whole_numbers(vectors, id_col, vec_col)
    if not d:
        return vectors.sparkSession.createDataFrame([], schema)
    fit = _graph.cut(rows.select("x").distinct())
    sums = fit.mapInArrow(partial(_add_up, d=d), "at int, high long, low long, n long").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n"))
    sums = sorted(sums.collect())
    n, s = sums[0]["n"], [(r["high"] << LOW) + r["low"] for r in sums]
    trace = 0.0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal trace
        z = _summed(fit, partial(_product, n=n, s=s, q=q), (d + 1, q.shape[1])) / n
        trace = z[-1, 0]
        return z[:-1]

    e, y, _, _ = leading_pairs(times, d, k)
    some = e > FLAT * trace
    if not some.any():
        return vectors.sparkSession.createDataFrame([], schema)
    e, w = e[some], y[:, some] / np.sqrt(e[some])
    second = _summed(fit, partial(_second, n=n, s=s, w=w), (len(e) + 1, len(e))) / n
    error = float(np.abs(second[:-1] - np.outer(second[-1], second[-1]) - np.eye(len(e))).max())
    return rows.mapInArrow(partial(_rows, n=n, s=s, w=w, explained=e / trace, error=error), schema)
