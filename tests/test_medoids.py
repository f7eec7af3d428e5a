"""Exact medoids against all pairs."""

import numpy as np
import pytest

from trailmark.operators import series
from trailmark.operators.medoids import medoids


def frame(spark, rows):
    return spark.createDataFrame([(f"p{i:04d}", c, [float(v) for v in x] if x is not None else None) for i, (c, x) in enumerate(rows)], "person string, cluster int, series array<double>")


def plain(rows):
    out = {}
    for c in {c for c, x in rows if x is not None and c is not None}:
        own = [(f"p{i:04d}", np.array(x, float)) for i, (g, x) in enumerate(rows) if g == c and x is not None]
        out[c] = min((round(float(sum(np.sqrt(((x - y) ** 2).sum()) for _, y in own)), 9), k) for k, x in own)[1]
    return out


def test_the_point_nearest_the_mean_is_not_the_medoid(spark):
    rows = [(0, [v]) for v in (0, 1, 1.1, 10, 0.9)]
    assert {r.cluster: r.person for r in series.medoid(frame(spark, rows)).collect()} == {0: "p0001"}


@pytest.mark.parametrize("dim", [1, 3, 16])
def test_medoids_equal_all_pairs(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(int(c), rng.normal(size=dim) * (1 + c) + 5 * c) for c in rng.integers(0, 4, 240)]
    rows += [(7, [3.0] * dim), (8, [1.0] * dim), (8, [1.0] * dim), (8, [1.0] * dim), (None, [0.0] * dim), (9, None)]
    rows += [(2, rows[5][1]), (2, rows[5][1])]
    found, asked = medoids(frame(spark, rows), ["person"], "series", block=16)
    assert {r.cluster: r.person for r in found.collect()} == plain(rows)
    assert asked < len(rows) * 3


def test_bounds_leave_most_members_out(spark):
    rng = np.random.default_rng(5)
    rows = [(0, x) for x in rng.normal(size=(1500, 3)) * [50, 1, 1]]
    found, asked = medoids(frame(spark, rows), ["person"], "series", block=64)
    assert {r.cluster: r.person for r in found.collect()} == plain(rows) and asked < 300


def test_no_rows(spark):
    assert series.medoid(frame(spark, []).limit(0)).count() == 0


def sent(spark):
    """Bytes of all results sent to the driver so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).resultSize() for i in range(stages.size()))


def test_each_member_is_sent_to_the_driver_once_at_most(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1200, 256))
    rows = [(0, v) for v in x / np.linalg.norm(x, axis=1)[:, None]]  # bounds leave none of these out
    before = sent(spark)
    found, asked = medoids(frame(spark, rows).repartition(8), ["person"], "series", block=64)
    assert {r.cluster: r.person for r in found.collect()} == plain(rows) and asked >= 1200
    assert sent(spark) - before < 9_000_000
