"""Tail probabilities against plain Python, and the tests that report them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.functions import tails
from trailmark.operators import models, stats, survival


def upper_gamma(a, x):
    """By the defining integral's series or continued fraction, term after term until nothing changes."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    t = x + 60_001 - a
    for k in range(30_000, 0, -1):
        t = x + 2 * k - 1 - a - k * (k - a) / t
    return front / t


def student(t, df, n=20_000):
    """Two-sided tail by Simpson's rule over the angle."""
    end = math.atan(abs(t) / math.sqrt(df))
    f = np.cos(np.linspace(0, end, n + 1)) ** (df - 1)
    whole = (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()) * end / n / 3
    return 1 - 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi) * whole


def test_normal_and_chi_square_tails(spark):
    rows = [(float(k), x) for k in (1, 2, 3, 5, 10, 31, 100, 1000) for x in (0.0, 1e-9, 0.01, 0.3, 1.0, 1.9, 3.1, 4.0, 10.0, 40.0, 90.0, 110.0, 990.0, 1100.0)]
    got = spark.createDataFrame(rows, "k double, x double").select("k", "x", tails.chi2_p(F.col("x"), F.col("k")).alias("p"), tails.normal_p(F.col("x")).alias("z")).collect()
    for r in got:
        want = upper_gamma(r.k / 2, r.x / 2)
        assert abs(r.p - want) < 1e-11 and (want < 1e-290 or abs(r.p / want - 1) < 1e-8)
        assert abs(r.z - math.erfc(r.x / math.sqrt(2))) < 1e-13


def test_student_tail_at_known_points(spark):
    # Two-sided 5 % and 1 % points of Student's t, as printed in tables.
    printed = {1: (12.7062, 63.6567), 2: (4.30265, 9.92484), 3: (3.18245, 5.84091), 5: (2.57058, 4.03214), 10: (2.22814, 3.16927), 20: (2.08596, 2.84534), 30: (2.04227, 2.74999), 60: (2.00030, 2.66028), 120: (1.97993, 2.61742), 1000: (1.96234, 2.58075)}
    points = [(float(k), t, p) for k, both in printed.items() for t, p in zip(both, (0.05, 0.01), strict=True)]
    got = spark.createDataFrame(points, "k double, t double, p double").select("*", tails.t_p(F.col("t"), F.col("k")).alias("got")).collect()
    assert len(got) == 20 and all(abs(r.got - r.p) < 2e-6 for r in got)
    rows = [(float(k), t) for k in (1, 2, 7, 30, 399, 401, 5000) for t in (1e-6, -0.1, 0.9, 2.0, 3.3, 6.0)]
    for r in spark.createDataFrame(rows, "k double, t double").select("*", tails.t_p(F.col("t"), F.col("k")).alias("p")).collect():
        assert abs(r.p - student(r.t, r.k)) < 1e-9


def test_arguments_without_a_tail_give_null(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(None, 3.0), (nan, 3.0), (1.0, 0.0), (1.0, None), (inf, 4.0)], "x double, k double")
    got = rows.select(tails.chi2_p(F.col("x"), F.col("k")).alias("c"), tails.t_p(F.col("x"), F.col("k")).alias("t"), tails.normal_p(F.col("x")).alias("z")).collect()
    assert [tuple(r) for r in got[:2]] == [(None, None, None)] * 2 and [(r.c, r.t) for r in got[2:4]] == [(None, None)] * 2 and tuple(got[4]) == (0.0, 0.0, 0.0)


def test_p_of_correlations_and_constant_features(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "g", int(y), "a", float(x + y)) for i, (x, y) in enumerate(zip(rng.normal(size=60), rng.integers(0, 2, 60), strict=True))]
    rows += [(i, "g", y, "flat", 1.0) for i, _, y, _, _ in rows[:60]]
    frame = spark.createDataFrame(rows, "id int, grp string, label int, metric string, x double")
    got = {r.feature: r for r in models.pearson_by_group(frame, "label", "grp").collect()}
    r = np.corrcoef([q[4] for q in rows[:60]], [q[2] for q in rows[:60]])[0, 1]
    assert abs(got["a"].r - r) < 1e-12 and abs(got["a"].p_value - student(r * math.sqrt(58 / (1 - r * r)), 58)) < 1e-9
    assert got["flat"].r is None and got["flat"].p_value is None
    tests = {r.feature: r for r in models.feature_label_tests(frame, "label").collect()}
    rho = tests["a"].spearman
    assert abs(tests["a"].spearman_p - student(rho * math.sqrt(58 / (1 - rho * rho)), 58)) < 1e-9 and tests["flat"].spearman_p is None and tests["flat"].p_value == 1.0


def test_chi_square_of_counts(spark):
    rows = spark.createDataFrame([("m", 10, 20), ("m", 25, 15), ("three", 1, 9), ("three", 5, 5), ("three", 8, 4), ("none", 0, 4), ("none", 0, 9), ("one", 3, 3)], "k string, yes bigint, no bigint")
    got = {r.k: r for r in stats.chi_square_of_counts(rows, "yes", "no", ["k"]).collect()}
    for k, table, yates in (("m", [[10, 20], [25, 15]], 0.5), ("three", [[1, 9], [5, 5], [8, 4]], 0.0)):
        o = np.array(table, float)
        e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
        chi2 = (np.maximum(abs(o - e) - yates, 0) ** 2 / e).sum()
        assert abs(got[k].chi2 - chi2) < 1e-9 and abs(got[k].p_value - upper_gamma((len(o) - 1) / 2, chi2 / 2)) < 1e-9 and got[k].df == len(o) - 1
    assert all((got[k].chi2, got[k].df, got[k].p_value) == (None, None, None) for k in ("none", "one"))
    assert stats.chi_square_of_counts(rows.where("k = 'one'"), "yes", "no").first().chi2 is None


def plain_logrank(t, e, g, groups):
    k = len(groups)
    z, v = np.zeros(k), np.zeros((k, k))
    for at in np.unique(t[e == 1]):
        n = np.array([((t >= at) & (g == q)).sum() for q in groups], float)
        d = np.array([((t == at) & (e == 1) & (g == q)).sum() for q in groups], float)
        z += d - d.sum() * n / n.sum()
        if n.sum() > 1:
            v += d.sum() * (n.sum() - d.sum()) / (n.sum() - 1) * (np.diag(n / n.sum()) - np.outer(n, n) / n.sum() ** 2)
    return float(z[:-1] @ np.linalg.pinv(v[:-1, :-1]) @ z[:-1])


@pytest.fixture(scope="module")
def lives(spark):
    rng = np.random.default_rng(7)
    n = 400
    g = rng.choice(["A", "B", "C"], n, p=[0.5, 0.3, 0.2])
    t = np.ceil(rng.exponential(np.where(g == "A", 20, np.where(g == "B", 30, 14)))).astype(float)
    e = (rng.random(n) < 0.7).astype(int)
    return spark.createDataFrame([(str(a), float(b), int(c)) for a, b, c in zip(g, t, e, strict=True)], "project_type string, duration double, event int"), t, e, g


def test_logrank_of_several_groups(lives):
    frame, t, e, g = lives
    got = survival.logrank_k(frame, ["A", "B", "C"]).first()
    want = plain_logrank(t, e, g, ["A", "B", "C"])
    assert abs(got.chi2 - want) < 1e-8 and got.df == 2 and abs(got.p_value - upper_gamma(1.0, want / 2)) < 1e-9
    two, pair = survival.logrank_k(frame, ["A", "B"]).first(), survival.logrank_test(frame, "A", "B").first()
    assert abs(two.chi2 - pair.chi2) < 1e-8 and abs(two.p_value - pair.p_value) < 1e-10 and abs(two.expected - pair.expected) < 1e-8
    alone = survival.logrank_k(frame.where("project_type = 'A'"), ["A", "B"]).first()
    assert alone.groups == 1 and alone.chi2 is None and alone.p_value is None


def test_truncated_logrank_of_several_groups(lives):
    frame, t, e, g = lives
    got = {r.cutoff: r for r in survival.truncated_logrank(frame, ["A", "B", "C"]).collect()}
    assert {10, 20, 30, 52} <= set(got)
    for cutoff, r in got.items():
        own = t <= cutoff
        want = plain_logrank(t[own], np.where(t[own] == cutoff, 0, e[own]), g[own], ["A", "B", "C"])
        assert abs(r.chi2 - want) < 1e-8 and abs(r.p_value - upper_gamma(1.0, want / 2)) < 1e-9
