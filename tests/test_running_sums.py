"""Running sums by two levels against plain loops."""

import math
import random

from trailmark.operators import stats

VALUES = [0.0, -0.0, 1e-9, 1e-6, 0.25, 0.5, 0.500001, 1.0, 3.0, 1e5, 1e5 + 1, 1e300, math.inf]


def test_bins_never_fall_as_values_grow(spark):
    rnd = random.Random(1)
    values = sorted([v * s for v in VALUES for s in (1, -1)] + [rnd.uniform(-1, 1) * 10 ** rnd.randrange(-8, 9) for _ in range(500)]) + [math.nan]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    bins = [r.b for r in rows.withColumn("b", stats.value_bin(rows.x)).orderBy("i").collect()]
    assert bins == sorted(bins)
    assert len(set(bins)) > 300


def test_sums_below_and_over_all(spark):
    rnd = random.Random(2)
    data = {(k, rnd.choice(VALUES) * rnd.choice([1, -1, 0.3])): (rnd.randrange(9), rnd.randrange(9)) for k in ("a", "b", None) for _ in range(60)}
    rows = spark.createDataFrame([(k, x, *v) for (k, x), v in data.items()], "k string, x double, p long, q long")
    for keys in (["k"], []):
        frame = rows if keys else rows.groupBy("x").agg({"p": "sum", "q": "sum"}).toDF("x", "a", "b").withColumnsRenamed({"a": "p", "b": "q"})
        plain = [r.asDict() for r in frame.collect()]
        got = stats.running_sums(frame, keys, "x", ["p", "q"]).collect()
        assert len(got) == len(plain)
        for r in got:
            own = [e for e in plain if not keys or e["k"] == r.k]
            for c in "pq":
                assert r[f"{c}_all"] == sum(e[c] for e in own)
                assert r[f"{c}_below"] == sum(e[c] for e in own if e["x"] < r.x)
    assert stats.running_sums(rows.where("false"), ["k"], "x", ["p"]).count() == 0


def test_quantiles_are_those_of_sorted_rows(spark):
    rnd = random.Random(3)
    data = [(k, rnd.choice([rnd.uniform(-5, 5), 1.0, 2.0])) for k, n in (("a", 1), ("b", 2), (None, 101), ("c", 40)) for _ in range(n)] + [("c", None), ("empty", None)]
    rows = spark.createDataFrame(data, "k string, v double")
    shares = {"low": 0.0, "q": 0.25, "m": 0.5, "late": 0.9, "top": 1.0}
    got = {r.k: r for r in stats.quantiles(rows, ["k"], "v", shares).collect()}
    assert set(got) == {"a", "b", "c", None}
    got["all"] = stats.quantiles(rows, [], "v", shares).first()
    for k, row in got.items():
        own = sorted(v for e, v in data if v is not None and k in (e, "all"))
        for name, p in shares.items():
            at = p * (len(own) - 1)
            low, high = own[math.floor(at)], own[math.ceil(at)]
            assert math.isclose(row[name], low + (high - low) * (at - math.floor(at)), abs_tol=1e-12)
    assert stats.quantiles(rows.where("false"), [], "v", shares).first() == (None,) * 5
    summary = {r.k: r for r in stats.quartile_summary(rows, ["k"], "v").collect()}
    assert set(summary) == {"a", "b", "c", None} and summary[None].n == 101 and summary["a"].std is None
