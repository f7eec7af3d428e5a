"""Euclidean k-means with many restarts and numbers of clusters in the same passes.

A run is one (k, restart). A pass reads the rows once: each task assigns its rows to the nearest centre of every run that still
moves and sends the sums of its clusters, so a pass costs one scan however many runs there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from which starting centres are drawn, those whose ids hash lowest.
START_ROWS = 4096
Run = tuple[int, int]


def starts(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows drawn in turn by their squared distance to the nearest one drawn before."""
    rng = np.random.default_rng(seed)
    out = [x[rng.integers(len(x))]]
    near = ((x - out[0]) ** 2).sum(1)
    while len(out) < k:
        total = near.sum()
        out.append(x[rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))])
        near = np.minimum(near, ((x - out[-1]) ** 2).sum(1))
    return np.array(out)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row (of equal ones the first) and the squared distance to it."""
    return nearest_of(x, [centres])[0]


def nearest_of(x: np.ndarray, sets: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """nearest() for each of several sets of centres. One product of matrices gives all distances but for its rounding; rows whose
    two nearest centres are as close as that are told by differences."""
    size, xx, out = 4096, (x * x).sum(1), [([], []) for _ in sets]
    every = np.concatenate(sets)
    cc = (every * every).sum(1)
    for begin in range(0, len(x), size):
        part = x[begin : begin + size]
        whole = xx[begin : begin + size, None] + cc - 2 * (part @ every.T)
        start = 0
        for (ats, squares), centres in zip(out, sets, strict=True):
            square = whole[:, start : start + len(centres)]
            at = square.argmin(1)
            if len(centres) > 1:
                two = np.partition(square, 1, axis=1)
                near = np.flatnonzero(two[:, 1] - two[:, 0] <= 1e-9 * (xx[begin : begin + size] + cc[start : start + len(centres)].max()))
                if len(near):
                    at[near] = np.stack([((part[near] - c) ** 2).sum(1) for c in centres], 1).argmin(1)
            ats.append(at)
            squares.append(((part - centres[at]) ** 2).sum(1))
            start += len(centres)
    return [(np.concatenate(a), np.concatenate(s)) if a else (np.zeros(0, int), np.zeros(0)) for a, s in out]


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of arrays of equal length, not null."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _rows(k: int, restart: int, i: Sequence[int], v: Sequence[float], far: Sequence[float], x: Sequence[Sequence[float]]) -> pa.RecordBatch:
    n, kinds = len(i), (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
    columns = ([k] * n, [restart] * n, i, v, far, x)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["k", "restart", "i", "v", "far", "x"])


def _pass(rows: DataFrame, column: str, runs: dict[Run, np.ndarray]) -> tuple[dict, dict, dict]:
    """Of each run: sums and sizes of its clusters, its cost, and the row farthest from its centre."""
    shared = rows.sparkSession.sparkContext.broadcast(runs)

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[Run, np.ndarray] = {}
        cost: dict[Run, float] = {}
        far: dict[Run, tuple[float, list[float]]] = {}
        for part in parts:
            if not part.num_rows:
                continue
            x = matrix(part.column(0))
            whole = np.concatenate([np.ones((len(x), 1)), x], 1)
            for (run, centres), (at, square) in zip(shared.value.items(), nearest_of(x, list(shared.value.values())), strict=True):
                hot = np.zeros((len(centres), len(x)))
                hot[at, np.arange(len(x))] = 1
                total[run] = total.get(run, 0.0) + hot @ whole
                cost[run] = cost.get(run, 0.0) + float(square.sum())
                i = int(square.argmax())
                far[run] = max(far.get(run, (-1.0, [])), (float(square[i]), x[i].tolist()))
        for (k, restart), s in total.items():
            values = s.ravel()
            yield _rows(k, restart, np.arange(len(values)), values, [-1.0] * len(values), [[]] * len(values))
            yield _rows(k, restart, [-1], [cost[k, restart]], [far[k, restart][0]], [far[k, restart][1]])

    found = rows.select(column).mapInArrow(sums, "k int, restart int, i int, v double, far double, x array<double>")
    found = found.groupBy("k", "restart", "i").agg(F.sum("v").alias("v"), F.max_by("x", F.struct("far", "x")).alias("x")).toPandas()
    total, cost, far = {}, {}, {}
    for (k, restart), own in found.groupby(["k", "restart"]):
        own = own.sort_values("i")
        total[k, restart] = own["v"].to_numpy()[1:].reshape(k, -1)
        cost[k, restart], far[k, restart] = float(own["v"].iloc[0]), np.array(own["x"].iloc[0], float)
    return total, cost, far


def fit_kmeans(rows: DataFrame, column: str, ks: Sequence[int], restarts: int = 10, seed: int = 42, steps: int = 50, first: dict[Run, np.ndarray] | None = None) -> dict[Run, tuple[np.ndarray, float]]:
    """(k, restart) -> (centres, cost: summed squared distances). rows: `column`, arrays of equal length without nulls; read once a
    step, so hand in a written table.

    Starting centres come from at most START_ROWS rows unless `first` gives them. A cluster that loses all rows starts anew at
    the run's farthest row. A run ends when its centres stay; no rows give no runs.
    """
    if first is None:
        few = rows.orderBy(F.xxhash64(F.lit(seed), column), column).limit(START_ROWS).select(column).collect()
        if not few:
            return {}
        x = np.array([r[0] for r in few], float)
        first = {(k, r): starts(x, k, seed + r) for k in ks for r in range(restarts)}
    moving, done = dict(first), {}
    for step in range(steps + 1):
        total, cost, far = _pass(rows, column, moving)
        if not total:
            return {}
        ahead = {}
        for run, centres in moving.items():
            n = total[run][:, :1]
            new = np.where(n > 0, total[run][:, 1:] / np.maximum(n, 1), centres)
            empty = np.flatnonzero(n[:, 0] == 0)
            if len(empty) and not (centres == far[run]).all(1).any():
                new[empty[0]] = far[run]
            if np.allclose(new, centres, rtol=0, atol=1e-9) or step == steps:
                done[run] = (centres, cost[run])
            else:
                ahead[run] = new
        if not ahead:
            break
        moving = ahead
    return done


def assigned(rows: DataFrame, column: str, centres: Sequence[np.ndarray], name: str = "clusters") -> DataFrame:
    """Adds `name`: the nearest centre's number by each of the given sets of centres."""
    shared = rows.sparkSession.sparkContext.broadcast([np.array(c) for c in centres])

    @F.pandas_udf("array<int>")
    def label(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=object)
        x = np.stack(values.to_numpy()).astype(float)
        return pd.Series(np.stack([at for at, _ in nearest_of(x, shared.value)], 1).astype(np.int32).tolist())

    return rows.withColumn(name, label(F.col(column).cast("array<double>")))
