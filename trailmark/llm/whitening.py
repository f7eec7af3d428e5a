"""Embedding whitening by shifted CholeskyQR.

Entries are made whole numbers, floor(scale c). The rows of the fit list (each distinct vector once, centred) are a tall matrix
A. A pass sums the Gram matrix of the rows over the tasks; its Cholesky factor orthogonalises the rows by a triangular
solve, and the next pass sums the Gram matrix of the rows so solved. The first factors are shifted, so that they exist
however close to dependent the columns are. When the Gram matrix is the identity, A = Q R with the product R of all
factors, and the singular values and right vectors of R, a small matrix, are those of A: no covariance matrix is
formed whose small eigenvalues its rounding would drown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm._arrow import map_arrow, written_table
from trailmark.llm._gather import PARTS, gathered, parts

#: A Gram matrix this near to the identity ends the passes; its own factor still goes into R.
NEAR = 1e-10
#: Passes at most. Three do for independent columns (one shifted), each more handles columns a million times nearer to dependent.
PASSES = 6
#: Components with less than this part of the first one's standard deviation count as without variance.
LEAST = 1e-12


@dataclass
class Whitening:
    """n: vectors of the fit list; sums: of their whole entries; components: a column each, unit length, by falling
    eigenvalue of the covariance; trace: of all eigenvalues."""

    n: int
    scale: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def proper(self, k: int) -> int:
        """How many of the first k components have variance."""
        e = self.eigenvalues[:k]
        return int((e > LEAST**2 * self.eigenvalues[0]).sum()) if len(e) else 0

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """Whitened coordinates of the first k components that have variance."""
        k = self.proper(k)
        return (x - self.mean) @ self.components[:, :k] / np.sqrt(self.eigenvalues[:k])


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows R^-1 for upper triangular factors R in turn, by substitution."""
    out = np.array(rows, np.float64, order="F")
    for r in factors:
        for j in range(out.shape[1]):
            out[:, j] = (out[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dim)


def gram(fit: DataFrame, dim: int, image: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of y'y over the rows x of the fit list, y = image(x as a matrix of rows). Each task sends one matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = image(_matrix(batch.column(0), dim))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield parts(total.ravel())

    size = image(np.zeros((1, dim), np.int64)).shape[1]
    return gathered(map_arrow(fit, run, PARTS), "<f8", size * size, np.add).reshape(size, size)


def factor(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper triangular R with R'R = G + shift I; the shift grows until there is one."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, np.finfo(float).eps * float(np.trace(g)))


def orthogonalised(gram_of, n: int, dim: int) -> np.ndarray:
    """A square root of A'A (its Gram matrix is A'A): the product of the passes' factors. gram_of: the Gram matrix of A's rows
    solved by given factors."""
    factors: list[np.ndarray] = []
    eps = np.finfo(float).eps / 2
    for k in range(PASSES):
        g = gram_of(factors)
        own = np.linalg.eigvalsh(g)
        # Directions without variance stay at nothing in every pass, all others reach 1.
        done = k > 0 and bool(((np.abs(own - 1) < NEAR) | (own < NEAR)).all())
        if done or k == PASSES - 1 or not g.any():
            break
        # The bound under which the shifted factor of an n x d matrix exists in spite of rounding.
        factors.append(factor(g, 11 * (n * dim + dim * (dim + 1)) * eps * own[-1] if k == 0 else 0.0))
    if own[0] > 0.5:
        last = np.linalg.cholesky(g).T
    else:
        values, vectors = np.linalg.eigh(g)
        last = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
    for r in reversed(factors):
        last = last @ r
    return last


def whole_vectors(frame: DataFrame, vec_col: str, scale: int) -> Column:
    """array<bigint> floor(scale c), null where the vector is null, empty, or holds null or non-finite entries."""
    v = F.col(vec_col).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when((F.size(v) > 0) & good, F.transform(v, lambda c: F.floor(c * F.lit(float(scale)))))


def with_whole(frame: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, x) of the rows that take part: those with finite vectors, of the commonest length (of several: the longest)."""
    rows = frame.select(F.col(id_col).alias("id"), whole_vectors(frame, vec_col, scale).alias("x")).where("x IS NOT NULL")
    sizes = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    return rows.where(F.size("x") == (sizes[0]["dim"] if sizes else 0))


def fit_whitening(frame: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 4, scale: int = 256) -> Whitening | None:
    """Fit on the distinct whole vectors of all rows. None if no row takes part (see with_whole).

    Sums are exact; entries past a bigint's range count as its ends. identity_error is the largest entry of the first k whitened
    components' covariance minus the identity, None where none has variance.
    Scale: the fit list is written once to the checkpoint folder, then read by each pass (three and one for the error, as
    a rule); a task sends a matrix as large as the components squared, which is all that the driver gets.
    """
    rows = with_whole(frame, id_col, vec_col, scale)
    with written_table(rows.select("x").distinct()) as fit:
        totals = fit.select(F.posexplode("x").alias("j", "c")).groupBy("j").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("j").collect()
        if not totals:
            return None
        sums, n, dim = [int(r["s"]) for r in totals], totals[0]["n"], len(totals)
        mean = np.array([s / n for s in sums])

        def gram_of(factors: list[np.ndarray]) -> np.ndarray:
            return gram(fit, dim, lambda x: solved(x - mean, factors))

        root = orthogonalised(gram_of, n, dim)
        _, s, vt = np.linalg.svd(root)
        components = vt.T * np.sign(vt.T[np.abs(vt).argmax(1), np.arange(dim)])
        values = s * s / n
        out = Whitening(n, scale, sums, components, values, float(values.sum()))
        own = out.proper(k)
        if own:
            # A column of ones gives the means, which the covariance leaves out.
            g = gram(fit, dim, lambda x: np.concatenate([out.project(x, k), np.ones((len(x), 1))], 1)) / n
            out.identity_error = float(np.abs(g[:own, :own] - np.outer(g[:own, own], g[:own, own]) - np.eye(own)).max())
        return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over the components of (n x - S)^2; None where that passes a bigint."""
    most = max(n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))), 0) + max(map(abs, sums))
    if most * most * len(sums) < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


RESULT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(frame: DataFrame, model: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 4) -> DataFrame:
    """The first k whitened coordinates of every row, a row for each component (from 1).

    Returns the id, `component`, `n` (vectors of the fit list), `deviation` (exact sum of (n x - S)^2 over a row's whole entries x
    with the fit list's sums S; null past a bigint), `whitened` (null for components without variance), `explained` (the
    component's part of the variance; 0 without any) and `identity_error` (see fit_whitening). Rows whose vector is null,
    empty, of another length than the model's, or holds null or non-finite entries are left out; null and repeated ids
    stay; with fewer than k entries there are as many components. An empty table (model None) gives no rows. Other columns
    are left out. Scale: no shuffle; the model is a broadcast of components squared.
    """
    key = frame.schema[id_col].dataType.simpleString()
    if model is None:
        return frame.sparkSession.createDataFrame([], f"{id_col} {key}, {RESULT}")
    dim, shown, own = len(model.sums), min(k, len(model.sums)), model.proper(k)
    rows = frame.select(F.col(id_col).alias("id"), whole_vectors(frame, vec_col, model.scale).alias("x")).where(F.size("x") == dim)
    share = model.eigenvalues[:shown] / model.trace if model.trace > 0 else np.zeros(shown)
    shared = frame.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column(1), dim)
            white = np.full((m, shown), np.nan)
            white[:, :own] = shared.value.project(x, k)
            each = lambda v: pa.array(v).take(pa.array(np.repeat(np.arange(m), shown)))
            whitened = pc.if_else(pa.array(np.tile(np.arange(shown) < own, m)), pa.array(white.ravel()), pa.nulls(m * shown, pa.float64()))
            cols = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), shown))),
                pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), m)),
                pa.array(np.full(m * shown, model.n, np.int64)),
                each(pa.array(deviations(x, model.n, model.sums), pa.int64())),
                whitened,
                pa.array(np.tile(share, m)),
                pa.array([model.identity_error] * (m * shown), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(rows, run, f"id {key}, {RESULT}").withColumnRenamed("id", id_col)


def whitening_report(frame: DataFrame) -> DataFrame:
    """Four whitened components of every vector, fitted on all distinct ones."""
    return whiten(frame, fit_whitening(frame))
