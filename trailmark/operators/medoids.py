"""Exact medoids by bounds: the member of a cluster with the least summed Euclidean distance to its members.

A member's sum is bounded from below without pairs: by the distance to the cluster's mean (n times), and by the distances to a
few pivots, as |d(x, p) - d(y, p)| never passes d(x, y) and its sum over y follows from counts and sums of d(y, p) in bins of
values. Members are then summed exactly in order of their bounds, a block at a time against all rows, until no bound is
below the best sum found. No pairs are made into rows; a block's vectors and one sum a task for each are all that moves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.stats import value_bin
from trailmark.operators.written import written

#: Pivots of a cluster, its farthest members from the mean; members summed in a round; clusters whose means and pivots are broadcast at most.
PIVOTS, BLOCK, MOST_CLUSTERS = 4, 2048, 20_000


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all of b; near ones, where the products cancel, by their differences."""
    aa, bb = (a * a).sum(1)[:, None], (b * b).sum(1)[None]
    square = aa + bb - 2 * a @ b.T
    i, j = np.nonzero(square < 1e-5 * (aa + bb))
    square[i, j] = ((a[i] - b[j]) ** 2).sum(1)
    return np.sqrt(np.maximum(square, 0))


def _by_cluster(part: pd.DataFrame) -> Iterator[tuple[object, pd.DataFrame, np.ndarray]]:
    for cluster, own in part.groupby("cluster", sort=False):
        yield cluster, own, np.stack(own["x"].to_numpy()).astype(float)


def _euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v))


def bounded_members(rows: DataFrame) -> DataFrame:
    """rows (member, cluster, x) with `bound`, at most the member's summed distance to its cluster."""
    means = rows.select("cluster", F.posexplode("x").alias("i", "v")).groupBy("cluster", "i").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    means = means.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("mean"), F.max("n").alias("n"))
    held = {r["cluster"]: (r["n"], r["mean"]) for r in means.limit(MOST_CLUSTERS + 1).collect()}
    if len(held) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    # Far members see a cluster along its length. Each broadcast has a few rows a cluster, of which there are few.
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("off"), "member"))
    pivots = rows.join(F.broadcast(means.select("cluster", "mean")), "cluster").withColumn("off", _euclid(F.col("x"), F.col("mean")))
    pivots = pivots.withColumn("p", place).where(F.col("p") <= PIVOTS).select("cluster", "p", F.col("x").alias("pivot"))
    far = rows.join(F.broadcast(pivots), "cluster").select("cluster", "p", _euclid(F.col("x"), F.col("pivot")).alias("d"))
    bins = far.groupBy("cluster", "p", value_bin(F.col("d")).alias("bin")).agg(F.min("d").alias("low"), F.count(F.lit(1)).alias("k"), F.sum("d").alias("s"))
    tables: dict[tuple, list] = {}
    for r in bins.orderBy("cluster", "p", "low").collect():
        tables.setdefault((r["cluster"], r["p"]), []).append((r["low"], r["k"], r["s"]))
    sums = {}
    for key, table in tables.items():
        low, k, s = (np.array(c, float) for c in zip(*table, strict=True))
        sums[key] = (low, np.append(0, np.cumsum(k)), np.append(0, np.cumsum(s)))
    points = {(r["cluster"], r["p"]): np.array(r["pivot"]) for r in pivots.collect()}
    shared = rows.sparkSession.sparkContext.broadcast((held, points, sums))

    def bound(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, points, sums = shared.value
        for part in parts:
            for cluster, own, x in _by_cluster(part):
                n, mean = held[cluster]
                best = n * np.sqrt(((x - np.array(mean)) ** 2).sum(1))
                for p in range(1, PIVOTS + 1):
                    if (cluster, p) in points:
                        d = np.sqrt(((x - points[cluster, p]) ** 2).sum(1))
                        low, k, s = sums[cluster, p]
                        at = np.maximum(np.searchsorted(low, d, "right") - 1, 0)
                        # Bins below and above the own one; those in it count as no distance.
                        best = np.maximum(best, d * k[at] - s[at] + (s[-1] - s[at + 1]) - d * (k[-1] - k[at + 1]))
                yield own.assign(bound=best * (1 - 1e-9))

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(bound, f"{own}, bound double")


def summed_distances(rows: DataFrame, some: list) -> dict[int, float]:
    """Exact sums of the distances of the members `some` (rows with cluster and x), by their place in the list."""
    own: dict = {}
    for i, r in enumerate(some):
        own.setdefault(r["cluster"], []).append((i, r["x"]))
    shared = rows.sparkSession.sparkContext.broadcast({c: (np.array([i for i, _ in v]), np.array([x for _, x in v], float)) for c, v in own.items()})

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for part in parts:
            for cluster, _, x in _by_cluster(part):
                if cluster in shared.value:
                    at, points = shared.value[cluster]
                    for i in range(0, len(x), 1024):
                        total[cluster] = total.get(cluster, 0.0) + _distances(x[i : i + 1024], points).sum(0)
        for cluster, s in total.items():
            yield pd.DataFrame({"i": shared.value[cluster][0], "s": s})

    return {r["i"]: r["s"] for r in rows.select("cluster", "x").mapInPandas(sums, "i bigint, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}


def medoids(clusters: DataFrame, keys: Sequence[str], column: str, digits: int = 9, block: int = BLOCK) -> tuple[DataFrame, int]:
    """(cluster, keys, total) of each cluster's medoid, and how many members were summed exactly. Sums are compared to `digits`
    digits, ties go to the smallest key; rows without vector or cluster are left out."""
    spark, x = clusters.sparkSession, F.col(column).cast("array<double>")
    rows = clusters.where(x.isNotNull() & F.col("cluster").isNotNull()).select(F.struct(*keys).alias("member"), "cluster", x.alias("x"))
    # Sorted once: a round's members follow each other, so each is sent to the driver once at most.
    rows = written(bounded_members(written(rows)).orderBy("bound", "member").withColumn("place", F.monotonically_increasing_id()))
    stretch = F.expr(f"place div {block}")  # of `block` members at most
    best: dict = {}
    asked = 0

    def ask(some: list) -> None:
        nonlocal asked
        sums = summed_distances(rows, some)
        asked += len(some)
        for i, r in enumerate(some):
            found = (round(sums[i], digits), r["member"])
            if r["cluster"] not in best or found < best[r["cluster"]]:
                best[r["cluster"]] = found

    first = F.row_number().over(Window.partitionBy("cluster").orderBy("bound", "place"))
    ask(rows.withColumn("first", first).where("first <= 4").collect())
    # Then all whose bounds may still win, the lowest bounds first; a round goes on where the last one ended, and takes the next
    # stretches that have `block` such members together.
    kind = clusters.schema["cluster"].dataType.simpleString()
    last = -1
    while best:
        limits = F.broadcast(spark.createDataFrame([(c, float(s)) for c, (s, _) in best.items()], f"cluster {kind}, most double"))
        todo = rows.join(limits, "cluster").where(F.col("bound") <= F.col("most") + 10.0**-digits).withColumn("stretch", stretch).where(F.col("stretch") > last)
        sizes = sorted((r["stretch"], r["n"]) for r in todo.groupBy("stretch").agg(F.count(F.lit(1)).alias("n")).collect())
        if not sizes:
            break
        last, taken = sizes[0]
        for at, n in sizes[1:]:
            if taken + n > block:
                break
            last, taken = at, taken + n
        ask(todo.where(F.col("stretch") <= last).select("member", "cluster", "x").collect())
    schema = ", ".join([f"cluster {kind}", *[f"`{k}` {clusters.schema[k].dataType.simpleString()}" for k in keys], "total double"])
    return spark.createDataFrame([(c, *m, s) for c, (s, m) in best.items()], schema), asked
