"""Models and tests without SQL against plain numpy, and checks against planted violations."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import dealing, flows, models, numbering, stats, survival
from trailmark.plans.catalog import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lives(spark):
    rng = np.random.default_rng(1)
    n = 120
    x, z = rng.normal(size=n), rng.integers(0, 2, n).astype(float)
    t = np.ceil(10 * rng.exponential(1 / np.exp(0.7 * x - 0.4 * z)))
    e = (rng.random(n) < 0.8).astype(int)
    rows = [(f"p{i}", "AB"[int(z[i])], float(t[i]), int(e[i]), float(x[i]), float(z[i])) for i in range(n)]
    return spark.createDataFrame(rows, "person string, project_type string, duration double, event int, x double, z double").persist(), np.stack([x, z], 1), t, e


def efron(beta, x, t, e):
    out, w = 0.0, np.exp(x @ beta)
    for at in np.unique(t[e == 1]):
        dead = (t == at) & (e == 1)
        d = dead.sum()
        out += (x[dead] @ beta).sum() - sum(np.log(w[t >= at].sum() - k / d * w[dead].sum()) for k in range(d))
    return out


def test_cox_against_the_plain_likelihood(lives):
    frame, x, t, e = lives
    model = survival.cox_ph(frame, ["x", "z"])
    assert model.events == e.sum() and abs(model.log_likelihood - efron(model.beta, x, t, e)) < 1e-6
    h, eye = 1e-4, np.eye(2)
    grad = [(efron(model.beta + h * d, x, t, e) - efron(model.beta - h * d, x, t, e)) / (2 * h) for d in eye]
    assert np.allclose(grad, 0, atol=1e-3)
    hess = np.array([[(efron(model.beta + h * (a + b), x, t, e) - efron(model.beta + h * (a - b), x, t, e) - efron(model.beta - h * (a - b), x, t, e) + efron(model.beta - h * (a + b), x, t, e)) / (4 * h * h) for b in eye] for a in eye])
    assert np.allclose(np.linalg.inv(-hess), model.covariance, rtol=1e-2)


def test_cox_curves_residuals_and_concordance(spark, lives):
    frame, x, t, e = lives
    model = survival.cox_ph(frame, ["x", "z"])
    risk = x @ model.beta
    w, times = np.exp(risk), np.unique(t)
    hazard = np.cumsum([((t == a) & (e == 1)).sum() / w[t >= a].sum() for a in times])
    got = {r.duration: r.survival for r in survival.cox_predict(model, frame, spark.createDataFrame([("q", 0.5, 1.0)], "person string, x double, z double")).collect()}
    assert np.allclose([got[a] for a in times], np.exp(-hazard * np.exp(0.5 * model.beta[0] + model.beta[1])))
    place = {a: i + 1 for i, a in enumerate(times)}
    dead = np.flatnonzero(e == 1)
    residual = np.array([x[i] - (w[t >= t[i]][:, None] * x[t >= t[i]]).sum(0) / w[t >= t[i]].sum() for i in dead])
    for j, r in enumerate(survival.ph_test(model, frame).orderBy("covariate").collect()):
        rho = np.corrcoef(residual[:, j], [place[t[i]] for i in dead])[0, 1]
        assert abs(r.rho - rho) < 1e-8 and abs(r.chi2 - len(dead) * rho**2) < 1e-6
    later = [(i, j) for i in dead for j in range(len(t)) if t[j] > t[i]]
    found = survival.concordance(model.risk(frame)).first()
    assert found.pairs == len(later) and abs(found["index"] - np.mean([(risk[i] > risk[j]) + (risk[i] == risk[j]) / 2 for i, j in later])) < 1e-9


def test_cox_by_group(lives):
    frame, x, t, e = lives
    rows = {(r.model, r.covariate): r for r in survival.cox_models(frame.withColumnRenamed("z", "is_second"), ["is_second", "x"], least=30).collect()}
    assert set(rows) == {("group", "is_second"), ("full", "is_second"), ("full", "x"), ("A", "x"), ("B", "x")}
    own = x[:, 1] == 1
    assert rows["B", "x"].events == e[own].sum() and all(0 <= r.concordance <= 1 for r in rows.values())
    b, h = rows["B", "x"].coef, 1e-4
    assert abs(efron(np.array([b + h]), x[own][:, :1], t[own], e[own]) - efron(np.array([b - h]), x[own][:, :1], t[own], e[own])) / (2 * h) < 1e-3


def test_survival_checks_find_violations(spark):
    good = spark.createDataFrame([("A", 1.0, 1), ("B", 2.0, 0)], "project_type string, duration double, event int")
    curve = spark.createDataFrame([(0.9, 0.8, 1.0)], "survival double, lower double, upper double")
    ok = lambda s, c: {r.check: r.ok for r in survival.survival_checks(s, c).collect()}
    assert all(ok(good, curve).values())
    bad = good.unionByName(spark.createDataFrame([("B", -1.0, 2), ("B", 9000.0, 1)], good.schema))
    found = ok(bad, spark.createDataFrame([(1.2, 0.9, 0.8)], curve.schema))
    assert not any(found[c] for c in ("events_binary", "durations_positive", "durations_plausible", "survival_in_range", "band_ordered"))
    assert not ok(good.where("project_type = 'A'"), curve)["both_groups"]


def test_rank_buckets():
    p = {("a", "b"): 0.2, ("a", "c"): 0.001, ("b", "c"): 0.01, ("c", "d"): 0.5, ("a", "d"): 0.001, ("b", "d"): 0.2}
    assert stats.rank_buckets({"a": 1.0, "b": 2.0, "c": 3.0, "d": 4.0}, p) == {"a": 1, "b": 1, "c": 2, "d": 2}
    assert stats.rank_buckets({}, {}) == {}


def test_paths_longer_than_any_fixed_length(spark):
    states = ["START", *[f"s{i}" for i in range(12)], "END"]
    edges = spark.createDataFrame([(a, b, 0.9) for a, b in zip(states, states[1:], strict=False)] + [("s0", "END", 0.1)], "src string, dst string, p double")
    top = flows.top_k_paths(edges, 2).orderBy("rank").collect()
    assert top[0].path == " > ".join(states) and abs(top[0].probability - 0.9**13) < 1e-12
    assert top[1].path == "START > s0 > END"


def simple_paths(p, start="START", end="END"):
    out, todo = [], [(1.0, (start,))]
    while todo:
        chance, path = todo.pop()
        for (a, b), q in p.items():
            if a == path[-1] and b not in path:
                todo.append((chance * q, (*path, b))) if b != end else out.append((chance * q, (*path, b)))
    return sorted(out, key=lambda r: (round(-np.log(r[0]), 9), r[1]))


@pytest.mark.parametrize("seed", range(4))
def test_paths_equal_enumeration(spark, seed):
    rng = np.random.default_rng(seed)
    states = ["START", *[f"s{i}" for i in range(5)], "END"]
    p = {(a, b): float(rng.choice([0.1, 0.2, 0.25, 0.5, rng.random()])) for a in states for b in states if a != b and a != "END" and b != "START" and rng.random() < 0.8}
    edges = spark.createDataFrame([(a, b, v) for (a, b), v in p.items()] + [("s0", "s0", 0.9), ("s1", "s2", None)], "src string, dst string, p double")
    want = simple_paths(p)
    for k in (1, 7, 10_000):
        got = flows.top_k_paths(edges, k).orderBy("rank").collect()
        assert [r.path for r in got] == [" > ".join(path) for _, path in want[:k]]
        assert all(abs(r.probability - c) < 1e-12 for r, (c, _) in zip(got, want, strict=False))


def test_paths_of_a_dense_graph_are_searched_not_enumerated(spark):
    rng = np.random.default_rng(9)
    states = ["START", *[f"s{i:02d}" for i in range(14)], "END"]
    rows = [(a, b, float(rng.uniform(0.05, 0.9))) for a in states for b in states if a != b and a != "END" and b != "START"]
    top = flows.top_k_paths(spark.createDataFrame(rows, "src string, dst string, p double"), 5).orderBy("rank").collect()
    assert len(top) == 5 and [r.probability for r in top] == sorted((r.probability for r in top), reverse=True)
    with pytest.raises(ValueError, match="states"):
        flows.top_k_paths(spark.range(1001).selectExpr("'START' AS src", "string(id) AS dst", "0.5D AS p"), 1)


def test_efron_sums_of_a_million_events_take_little_memory():
    import tracemalloc

    whole, tied, d = 2.5e6, 1.3e6, 1_000_000
    tracemalloc.start()
    got = survival.efron_sums(whole, tied, d)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    f = np.arange(d) / d
    z = whole - f * tied
    assert np.allclose(got, [np.log(z).sum(), (1 / z).sum(), (f / z).sum(), (1 / z**2).sum(), (f / z**2).sum(), (f * f / z**2).sum()], rtol=1e-10)


def test_small_groups_get_no_cox_model(lives):
    frame, x, t, e = lives
    found = survival.cox_models(frame.withColumnRenamed("z", "is_second"), ["is_second", "x"], least=1000)
    rows = found.collect()
    assert {r.model for r in rows} == {"group", "full"}
    full = next(r for r in rows if r.model == "full" and r.covariate == "x")
    assert full.people == len(t) and abs(full.log_likelihood - efron(np.array([r.coef for r in sorted((r for r in rows if r.model == "full"), key=lambda r: r.covariate != "x")]), x, t, e)) < 1e-6
    assert abs(full.p_value - __import__("math").erfc(abs(full.z) / 2**0.5)) < 1e-9


def test_permutation_importance_finds_the_feature(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), float(a > 0)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    frame = models.with_balance(spark.createDataFrame(rows, "id int, a double, b double, label double"), "label")
    model = models.prepared(["a", "b"], models.estimator("logistic", "label")).fit(frame)
    drop = {r.feature: r["drop"] for r in models.permutation_importance(model, frame, ["a", "b"], "label", ["id"], "logistic", repeats=3).collect()}
    assert drop["a"] > 0.3 and abs(drop["b"]) < 0.05


def test_dealt_vectors_are_counted_and_scored_once(spark, monkeypatch):
    monkeypatch.setattr(dealing, "PAGE_BYTES", 32 * 8 * 2 * 3)
    rng = np.random.default_rng(5)
    n, repeats, names = 300, 3, ["a", "b"]
    rows = [(i, None if i % 40 == 0 else float(rng.integers(0, 4)), float(rng.integers(0, 3)), float(rng.random() < 0.3 + i % 2 / 3), i) for i in range(n)]
    frame = spark.createDataFrame(rows, "id long, a double, b double, label double, place long")
    x, y = np.array([[np.nan if v is None else v for v in r[1:3]] for r in rows]), np.array([r[3] for r in rows])
    maps = models.bijections(n, repeats)
    want = Counter((-1, -1, y[i], *map(str, x[i])) for i in range(n))
    for k, (a, b) in enumerate(maps):
        j = (a * np.arange(n) + b) % n
        assert sorted(j) == list(range(n))
        for f in range(2):
            new = x.copy()
            new[:, f] = x[j, f]
            want.update((f, k, y[i], *map(str, new[i])) for i in range(n))
    found = Counter()
    for r in dealing.dealt_counts(frame, names, "label", "place", n, maps).collect():
        found[r.feature, r["repeat"], r.label, str(r.a), str(r.b)] += r["_n"]
    assert found == want

    whole = models.with_balance(frame, "label")
    model = models.prepared(names, models.estimator("logistic", "label")).fit(whole)
    seen = []

    class Counted:
        def transform(self, rows):
            seen.append(rows.count())
            return model.transform(rows)

    drops = {r.feature: r for r in models.permutation_importance(Counted(), whole, names, "label", ["id"], "logistic", repeats).collect()}
    # A table has 5 x 3 vectors of each label at most.
    assert seen and max(seen) <= 30 * (1 + 2 * repeats)
    order = [r.id for r in numbering.numbered(frame, ["id"]).orderBy("place").collect()]
    at = {i: k for k, i in enumerate(order)}
    place = np.array([at[i] for i in range(n)])
    table = np.empty((n, 2))
    table[place] = x

    def auc(values):
        given = spark.createDataFrame([(int(i), *[None if np.isnan(v) else float(v) for v in values[place[i]]]) for i in range(n)], "id long, a double, b double")
        score = {r.id: r.s for r in model.transform(given.withColumn("label", F.lit(0.0))).select("id", models.score_column("logistic").alias("s")).collect()}
        s = np.array([score[i] for i in range(n)])
        d = s[y == 1][:, None] - s[y == 0][None, :]
        return float(((d > 0) + (d == 0) / 2).mean())

    base = auc(table)
    for f, name in enumerate(names):
        own = []
        for a, b in maps:
            new = table.copy()
            new[:, f] = table[(a * np.arange(n) + b) % n, f]
            own.append(base - auc(new))
        assert abs(drops[name]["drop"] - np.mean(own)) < 1e-9 and abs(drops[name].spread - np.std(own)) < 1e-9


def test_vectors_of_many_values_are_counted():
    rng = np.random.default_rng(6)
    for columns in ([rng.random(500) for _ in range(9)], [rng.integers(0, 2, 500).astype(float) for _ in range(4)], [np.repeat([np.nan, 1.0], 250), rng.integers(0, 300, 500).astype(float)]):
        some, counts = dealing._counted([dealing._coded(c) for c in columns])
        found = {tuple(str(c[i]) for c in columns): int(k) for i, k in zip(some, counts, strict=True)}
        assert found == Counter(tuple(str(c[i]) for c in columns) for i in range(500))


def test_evaluation_scores_a_row_once(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(rng.random() < 0.4), float(rng.integers(0, 40) / 40)) for i in range(500)]
    calls = spark.sparkContext.accumulator(0)

    def score(x):
        calls.add(1)
        return x

    frame = spark.createDataFrame(rows, "id long, label double, x double").withColumn("score", F.udf(score, "double").asNondeterministic()("x"))
    found = models.eval_binary(frame, "label").collect()[0]
    assert calls.value == len(rows)
    y, s = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    f1 = [2 * y[s >= k / 20].sum() / ((s >= k / 20).sum() + y.sum()) for k in range(1, 20)]
    assert abs(found.best_f1 - max(f1)) < 1e-12 and found.threshold == (1 + int(np.argmax(f1))) / 20 and found.n == 500
    doubled = frame.drop("score").withColumn("score", F.col("x")).withColumn("k", F.lit(2))
    twice = models.eval_binary(doubled, "label", count="k").collect()[0]
    assert twice.n == 1000 and abs(twice.roc_auc - found.roc_auc) < 1e-12 and abs(twice.brier - found.brier) < 1e-12


@pytest.mark.parametrize("name, rows", [("train_classifiers", 6), ("feature_importance", 6), ("concordance_cv", 1), ("kmeans_best_k", 1)])
def test_models_run(name, rows, spark):
    found = QUERIES[name](spark, DIR).collect()
    assert len(found) >= rows
    if name == "train_classifiers":
        assert all(0 <= r.roc_auc <= 1 and 0 <= r.average_precision <= 1 for r in found)
    if name == "concordance_cv":
        assert 0 <= found[0]["mean"] <= 1
