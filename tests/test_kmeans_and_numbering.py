"""Batched k-means, labelings, exact numbering and folds."""

import math

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from trailmark.operators import kmeans, models, series
from trailmark.operators.numbering import numbered


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 1.0, (90, 4)) for c in ([0] * 4, [3, 0, 0, 0], [0, 4, 0, 1], [5, 5, 5, 5])])
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, series array<double>").persist(), x


def lloyd(x, centres, steps=50):
    for _ in range(steps):
        at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[at == k].mean(0) if (at == k).any() else centres[k] for k in range(len(centres))])
        if np.allclose(new, centres, rtol=0, atol=1e-9):
            break
        centres = new
    return centres, ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


def test_runs_equal_numpy_from_the_same_starts(points):
    frame, x = points
    first = {(k, r): kmeans.starts(x, k, 10 * k + r) for k in (2, 3, 5) for r in range(3)}
    got = kmeans.fit_kmeans(frame, "series", (2, 3, 5), first=first)
    assert set(got) == set(first)
    for run, start in first.items():
        centres, cost = lloyd(x, start)
        assert np.allclose(got[run][0], centres) and abs(got[run][1] - cost) < 1e-6
    labels = kmeans.assigned(frame, "series", [got[run][0] for run in sorted(got)]).orderBy("id").collect()
    for j, run in enumerate(sorted(got)):
        assert [r.clusters[j] for r in labels] == ((x[:, None] - lloyd(x, first[run])[0][None]) ** 2).sum(2).argmin(1).tolist()


def test_cost_is_no_worse_than_the_best_of_ten_plain_runs(points):
    frame, _ = points
    rows = frame.withColumn("features", array_to_vector("series"))
    plain = min(KMeans(k=4, seed=s, featuresCol="features").fit(rows).summary.trainingCost for s in range(10))
    sweep = {r.k: r for r in series.kmeans_sweep(frame, ["id"], (2, 4), restarts=10).collect()}
    assert sweep[4].cost <= plain * (1 + 1e-9) and sweep[4].silhouette > sweep[2].silhouette - 0.2


def test_a_cluster_without_rows_starts_anew(spark):
    frame = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([0, 0.1, 0.2, 9, 9.1, 20])], "id int, series array<double>")
    got = kmeans.fit_kmeans(frame, "series", (3,), first={(3, 0): np.array([[0.0], [100.0], [200.0]])})
    assert sorted(np.round(got[3, 0][0].ravel(), 3).tolist()) == [0.1, 9.05, 20.0]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "id int, series array<double>")
    assert {r.cluster for r in series.kmeans_series(same, 3).collect()} <= {0, 1, 2}
    assert series.kmeans_series(frame.limit(0), 3).count() == 0 and series.kmeans_sweep(frame.limit(0), ["id"]).count() == 0


def test_pairs_of_labelings_equal_the_index_of_each_pair(points):
    frame, _ = points
    labels = series.kmeans_labelings(frame, 3, seeds=4).persist()
    got = {(r.first, r.second): r.rand for r in series.rand_of_pairs(labels).collect()}
    assert set(got) == {(i, j) for i in range(4) for j in range(i + 1, 4)}
    for (i, j), rand in got.items():
        one = series.adjusted_rand(labels.select(F.col("labelings")[i].alias("a"), F.col("labelings")[j].alias("b")), "a", "b").first().rand
        assert abs(rand - one) < 1e-12
    quality = series.cluster_quality(labels.withColumn("cluster", F.col("labelings")[0]), ["id"], labelings="labelings").first()
    assert abs(quality.stability - np.mean(list(got.values()))) < 1e-12


def test_numbers_have_no_gaps(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 7 == 0, "rare").when(F.col("id") % 11 == 0, None).otherwise("common").alias("k"))
    out = numbered(rows, ["id"], ["k"]).collect()
    for k in ("rare", "common", None):
        own = sorted(r.place for r in out if r.k == k)
        assert own == list(range(len(own))) and len(own) > 100
    assert sorted(r.place for r in numbered(rows, ["id"]).collect()) == list(range(3000))


@pytest.mark.parametrize("n", [3, 1001, 5000])
def test_folds_of_a_label_differ_by_one_row_at_most(spark, n):
    rows = spark.range(n).select("id", (F.col("id") % 9 == 0).cast("int").alias("label"))
    for r in models.stratified_kfold(rows, "label", ["id"], 5).groupBy("label", "fold").count().groupBy("label").agg(F.max("count").alias("most"), F.min("count").alias("least"), F.count(F.lit(1)).alias("folds")).collect():
        assert r.most - r.least <= 1 and r.folds == min(5, sum((i % 9 == 0) == bool(r.label) for i in range(n)))


def test_bijections_move_every_row_once():
    for n in (1, 2, 12, 97, 360):
        for a, b in models.bijections(n, 5):
            assert math.gcd(a, n) == 1 and sorted((a * i + b) % n for i in range(n)) == list(range(n))
