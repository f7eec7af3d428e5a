"""Survival analysis on per-time aggregates. Durations are whole weeks, so there are few distinct times however many people."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import correlation, count_if
from trailmark.functions.tails import chi2_p, normal_p
from trailmark.operators.stats import quantiles, running_sums
from trailmark.operators.written import written

#: Distinct durations that the Cox steps take to the driver at most.
MOST_TIMES = 100_000
#: People whose curves are worked out at once: each gets a row for every time.
MOST_PEOPLE = 10_000


def survival_table(transitions: DataFrame) -> DataFrame:
    """The journeys with duration (time to event) and event (1: became core); durations of 0 or less go."""
    return transitions.withColumn("duration", F.col("time_to_event_weeks").cast("double")).withColumn("event", F.col("became_core").cast("int")).where("duration > 0")


def survival_subsets(survival: DataFrame, group: str = "project_type", commits: str = "total_commits", consistency: str = "commit_consistency_before_core") -> DataFrame:
    """The rows tagged with each subset they belong to: all, the group's name, high_activity (from the third quartile of
    commits on), low_activity (up to the first), consistent (from the median consistency on)."""
    survival = written(survival)
    q = quantiles(survival, [], commits, {"a": 0.25, "b": 0.75}).crossJoin(quantiles(survival, [], consistency, {"m": 0.5}))
    rows = survival.crossJoin(F.broadcast(q.select(F.array("a", "b").alias("q"), "m")))  # one row
    tags = F.array(
        F.lit("all"),
        F.lower(F.col(group)),
        F.when(F.col(commits) >= F.col("q")[1], "high_activity"),
        F.when(F.col(commits) <= F.col("q")[0], "low_activity"),
        F.when(F.col(consistency) >= F.col("m"), "consistent"),
    )
    return rows.withColumn("subset", F.explode(F.array_compact(tags))).drop("q", "m")


def with_strata(survival: DataFrame, commits: str = "total_commits", joined: str = "first_commit_week") -> DataFrame:
    """Adds activity_group (Low up to the first quartile of commits, Medium up to the third, High) and joiner_group (Early up
    to week 10, Mid up to 50, Late)."""
    survival = written(survival)
    q = quantiles(survival, [], commits, {"a": 0.25, "b": 0.75})
    rows = survival.crossJoin(F.broadcast(q.select(F.array("a", "b").alias("q"))))  # one row
    level = F.when(F.col(commits) <= F.col("q")[0], "Low").when(F.col(commits) <= F.col("q")[1], "Medium").otherwise("High")
    joiner = F.when(F.col(joined) <= 10, "Early").when(F.col(joined) <= 50, "Mid").otherwise("Late")
    return rows.withColumn("activity_group", level).withColumn("joiner_group", joiner).drop("q")


def risk_table(survival: DataFrame, keys: Sequence[str] = ("project_type",)) -> DataFrame:
    """keys, duration, events, leaving (all who end there), at_risk."""
    at = survival.groupBy(*keys, "duration").agg(F.sum("event").alias("events"), F.count(F.lit(1)).alias("leaving"))
    later = Window.partitionBy(*keys).orderBy("duration").rowsBetween(0, Window.unboundedFollowing)
    return at.withColumn("at_risk", F.sum("leaving").over(later))


def kaplan_meier(survival: DataFrame, keys: Sequence[str] = ("project_type",), z: float = 1.96) -> DataFrame:
    """The risk table with survival S(t) = product of 1 - events / at_risk, its Greenwood deviation and a plain band in 0..1."""
    r = risk_table(survival, keys)
    run = Window.partitionBy(*keys).orderBy("duration").rowsBetween(Window.unboundedPreceding, 0)
    gone = F.col("events") == F.col("at_risk")
    # The logarithm of a product; a factor of 0 (everyone left has the event) is kept apart.
    logs = F.sum(F.when(~gone, F.log(1 - F.col("events") / F.col("at_risk"))).otherwise(F.lit(0.0))).over(run)
    dead = F.max(F.when(gone, 1).otherwise(0)).over(run) == 1
    var = F.sum(F.when(~gone, F.col("events") / (F.col("at_risk") * (F.col("at_risk") - F.col("events")))).otherwise(F.lit(0.0))).over(run)
    out = r.withColumn("survival", F.when(dead, F.lit(0.0)).otherwise(F.exp(logs))).withColumn("std_error", F.col("survival") * F.sqrt(var))
    low, high = F.col("survival") - z * F.col("std_error"), F.col("survival") + z * F.col("std_error")
    return out.withColumn("lower", F.greatest(F.lit(0.0), low)).withColumn("upper", F.least(F.lit(1.0), high))


def survival_summary(curve: DataFrame, keys: Sequence[str] = ("project_type",), times: Sequence[int] = (4, 8, 12, 26, 52, 104)) -> DataFrame:
    """keys, median (first time with S at most 0.5; null if none) and s_<t>: S at each time (1 before the first)."""
    at = [F.coalesce(F.max_by(F.when(F.col("duration") <= t, F.col("survival")), F.when(F.col("duration") <= t, F.col("duration"))), F.lit(1.0)).alias(f"s_{t}") for t in times]
    return curve.groupBy(*keys).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("duration"))).alias("median"), *at)


def cumulative_incidence(curve: DataFrame) -> DataFrame:
    """The curve as 1 - S, with the band turned over."""
    return curve.withColumn("incidence", 1 - F.col("survival")).withColumn("incidence_lower", 1 - F.col("upper")).withColumn("incidence_upper", 1 - F.col("lower"))


def _per_time(survival: DataFrame, group: str, keys: Sequence[str]) -> DataFrame:
    """keys, duration, and for each of two groups events and at_risk. Groups are told apart by `is_first`."""
    first = F.col("is_first")
    at = survival.groupBy(*keys, "duration").agg(
        F.sum("event").alias("d"),
        F.sum(F.when(first, F.col("event")).otherwise(0)).alias("d1"),
        F.count(F.lit(1)).alias("c"),
        count_if(first).alias("c1"),
    )
    later = Window.partitionBy(*keys).orderBy("duration").rowsBetween(0, Window.unboundedFollowing)
    return at.withColumn("n", F.sum("c").over(later)).withColumn("n1", F.sum("c1").over(later))


def logrank_test(survival: DataFrame, first: str, second: str, group: str = "project_type", keys: Sequence[str] = ()) -> DataFrame:
    """keys, observed and expected events of the first group, chi2 and p_value of the two-sample log-rank test (null without variance)."""
    rows = survival.where(F.col(group).isin(first, second)).withColumn("is_first", F.col(group) == first)
    if not keys:
        rows, keys, dropped = rows.withColumn("_all", F.lit(0)), ["_all"], True
    else:
        dropped = False
    t = _per_time(rows, group, keys)
    d, n, n1 = (F.col(c).cast("double") for c in ("d", "n", "n1"))
    var = F.when(n > 1, d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1)).otherwise(F.lit(0.0))
    out = t.groupBy(*keys).agg(F.sum("d1").alias("observed"), F.sum(d * n1 / n).alias("expected"), F.sum(var).alias("variance"))
    gap = F.col("observed") - F.col("expected")
    out = out.withColumn("chi2", F.when(F.col("variance") > 0, gap * gap / F.col("variance"))).withColumn("p_value", chi2_p(F.col("chi2"), F.lit(1)))
    return out.drop("_all") if dropped else out


def logrank_k(survival: DataFrame, groups: Sequence[str], group: str = "project_type", keys: Sequence[str] = ()) -> DataFrame:
    """keys, groups (with rows), observed and expected events of the first of them, chi2, df and p_value of the log-rank test over
    all given groups; chi2 and p are null with fewer than two groups or without variance.

    The covariance of all groups but one is inverted as far as its rank goes. Work is a row for each duration and pair of groups,
    so it is meant for few groups; a task that inverts holds one key's matrix.
    """
    on = list(keys) or ["_all"]
    rows = survival.where(F.col(group).isin(*groups)).select(*([] if keys else [F.lit(0).alias("_all")]), *keys, F.col(group).alias("g"), "duration", F.col("event").cast("double").alias("event"))
    each = rows.groupBy(*on, "duration", "g").agg(F.sum("event").alias("d"), F.count(F.lit(1)).cast("double").alias("c"))
    own = F.map_from_entries(F.collect_list(F.struct("g", F.struct("d", "c"))))
    at = each.groupBy(*on, "duration").agg(F.sum("d").alias("d"), own.alias("own"))
    later = Window.partitionBy(*on).orderBy("duration").rowsBetween(0, Window.unboundedFollowing)
    name = lambda i, c: f"_{c}{i}"
    for i, g in enumerate(groups):
        cell = F.element_at("own", F.lit(g))
        at = at.withColumns({name(i, "d"): F.coalesce(cell["d"], F.lit(0.0)), name(i, "n"): F.sum(F.coalesce(cell["c"], F.lit(0.0))).over(later)})
    n = sum((F.col(name(i, "n")) for i in range(1, len(groups))), F.col(name(0, "n")))
    at = at.withColumn("n", n).where("d > 0")
    weight = F.when(F.col("n") > 1, F.col("d") * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    share = lambda i: F.col(name(i, "n")) / F.col("n")
    sums = [e for i in range(len(groups)) for e in (F.sum(name(i, "d")).alias(f"o{i}"), F.sum(F.col("d") * share(i)).alias(f"e{i}"))]
    sums += [F.sum(weight * share(i) * ((1.0 if i == j else 0.0) - share(j))).alias(f"v{i}_{j}") for i in range(len(groups)) for j in range(i, len(groups))]
    sizes = rows.groupBy(*on).agg(*[count_if(F.col("g") == g).alias(f"n{i}") for i, g in enumerate(groups)])
    wide = sizes.join(at.groupBy(*on).agg(*sums), on, "left")

    def tested(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                held = [i for i in range(len(groups)) if getattr(r, f"n{i}") > 0]
                chi2 = df = None
                if len(held) > 1 and not np.isnan(r.o0):
                    z = np.array([getattr(r, f"o{i}") - getattr(r, f"e{i}") for i in held[:-1]])
                    v = np.array([[getattr(r, f"v{min(i, j)}_{max(i, j)}") for j in held[:-1]] for i in held[:-1]])
                    df = int(np.linalg.matrix_rank(v, tol=1e-9))
                    chi2 = float(z @ np.linalg.pinv(v, rcond=1e-12) @ z) if df else None
                out.append((len(held), chi2, df))
            yield part[on].assign(groups=[x[0] for x in out], observed=part["o0"], expected=part["e0"], chi2=pd.array([x[1] for x in out], "Float64"), df=pd.array([x[2] for x in out], "Int64"))

    key_types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in on)
    found = wide.mapInPandas(tested, f"{key_types}, groups int, observed double, expected double, chi2 double, df bigint").withColumn("p_value", chi2_p(F.col("chi2"), F.col("df")))
    return found if keys else found.drop("_all")


def truncated_logrank(survival: DataFrame, groups: Sequence[str], group: str = "project_type", cutoffs: Sequence[int] = (10, 20, 30, 52, 78, 104), least: int = 10) -> DataFrame:
    """cutoff and the columns of logrank_k on durations up to it, events at the cutoff itself taken as censored; each group needs
    more than `least` rows."""
    t = survival.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs]))).where("duration <= cutoff")
    t = t.withColumn("event", F.when(F.col("duration") == F.col("cutoff"), 0).otherwise(F.col("event")))
    enough = F.lit(True)
    for i in range(len(groups)):
        enough = enough & (F.col(f"k{i}") > least)
    sizes = t.groupBy("cutoff").agg(*[count_if(F.col(group) == g).alias(f"k{i}") for i, g in enumerate(groups)]).where(enough)
    return logrank_k(t, groups, group, ["cutoff"]).join(sizes.select("cutoff"), "cutoff", "left_semi")


def event_rate_ratio(survival: DataFrame, first: str, second: str, group: str = "project_type") -> DataFrame:
    """One row: rate_first, rate_second, ratio (second over first; null if the first is 0)."""
    rate = lambda g: F.avg(F.when(F.col(group) == g, F.col("event")))
    out = survival.agg(rate(first).alias("rate_first"), rate(second).alias("rate_second"))
    return out.withColumn("ratio", F.when(F.col("rate_first") > 0, F.col("rate_second") / F.col("rate_first")))


def cox_frame(survival: DataFrame, second: str, group: str = "project_type", scale_by: DataFrame | None = None) -> DataFrame:
    """Adds is_second, and log1p commits, log1p lines and activity_rate standardised by population deviation (missing
    values by the median first), and second_x_commits."""
    raw = {"log_commits": F.log1p("total_commits"), "log_lines": F.log1p("total_lines_changed"), "rate": F.col("activity_rate").cast("double")}
    rows = survival.withColumns(raw).withColumn("is_second", (F.col(group) == second).cast("double"))
    rows = written(rows)
    stats = None
    for c in raw:
        one = quantiles(rows, [], c, {f"{c}_med": 0.5})
        stats = one if stats is None else stats.crossJoin(one)
    rows = rows.crossJoin(F.broadcast(stats)).withColumns({c: F.coalesce(c, f"{c}_med") for c in raw})  # one row
    scale = rows.agg(*[f(c).alias(f"{c}_{n}") for c in raw for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    rows = rows.crossJoin(scale).withColumns({c: F.when(F.col(f"{c}_sd") > 0, (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd")).otherwise(F.lit(0.0)) for c in raw})
    return rows.withColumn("second_x_commits", F.col("is_second") * F.col("log_commits")).drop(*[f"{c}_{n}" for c in raw for n in ("med", "mean", "sd")])


@dataclass
class CoxModel:
    covariates: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    rows: int
    events: int

    def summary(self, spark) -> DataFrame:
        """covariate, coef, hazard_ratio, std_error, lower, upper (of the ratio), z, p_value."""
        se = np.sqrt(np.diag(self.covariance))
        rows = [(c, float(b), float(np.exp(b)), float(s), float(np.exp(b - 1.96 * s)), float(np.exp(b + 1.96 * s)), float(b / s)) for c, b, s in zip(self.covariates, self.beta, se, strict=True)]
        return spark.createDataFrame(rows, "covariate string, coef double, hazard_ratio double, std_error double, lower double, upper double, z double").withColumn("p_value", normal_p(F.col("z")))

    def risk(self, frame: DataFrame) -> DataFrame:
        """Adds risk: the linear predictor."""
        out = F.lit(0.0)
        for c, b in zip(self.covariates, self.beta, strict=True):
            out = out + F.col(c) * float(b)
        return frame.withColumn("risk", out)


def efron_sums(whole: float, tied: float, d: int, step: int = 1 << 16) -> tuple[float, ...]:
    """Efron's sums over the d events of a time, with f = k / d and z = whole - f tied: of log z, 1 / z, f / z, 1 / z^2, f / z^2
    and (f / z)^2. These numbers are all that the d terms of the likelihood, gradient and Hessian need; `step` terms at a time."""
    out = np.zeros(6)
    for k in range(0, d, step):
        f = np.arange(k, min(k + step, d)) / d
        z = whole - f * tied
        q = f / z
        out += [np.log(z).sum(), (1 / z).sum(), q.sum(), (1 / (z * z)).sum(), (q / z).sum(), (q * q).sum()]
    return tuple(out)


def cox_ph(survival: DataFrame, covariates: Sequence[str], steps: int = 25, tolerance: float = 1e-9) -> CoxModel:
    """Cox model with Efron's ties by Newton steps.

    Each step is one aggregate by distinct duration of the weights, their first and second moments, and the same over the
    events; these few numbers for each time go to the driver, which adds them up from the last time back.
    """
    names = list(covariates)
    rows = survival.select(F.col("duration").cast("double").alias("duration"), F.col("event").cast("int").alias("event"), *[F.col(c).cast("double").alias(c) for c in names]).dropna()
    _few_times(rows)
    p, beta = len(names), np.zeros(len(names))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    last = -np.inf
    for _ in range(steps):
        score = F.lit(0.0)
        for c, b in zip(names, beta, strict=True):
            score = score + F.col(c) * float(b)
        w = F.exp(score)
        sums = [F.sum(w).alias("w"), *[F.sum(w * F.col(c)).alias(f"w{i}") for i, c in enumerate(names)], *[F.sum(w * F.col(names[i]) * F.col(names[j])).alias(f"w{i}_{j}") for i, j in pairs]]
        own = [F.sum("event").alias("d"), F.sum(F.when(F.col("event") == 1, score)).alias("s"), *[F.sum(F.when(F.col("event") == 1, F.col(c))).alias(f"x{i}") for i, c in enumerate(names)]]
        tied = [F.sum(F.when(F.col("event") == 1, w)).alias("v"), *[F.sum(F.when(F.col("event") == 1, w * F.col(c))).alias(f"v{i}") for i, c in enumerate(names)], *[F.sum(F.when(F.col("event") == 1, w * F.col(names[i]) * F.col(names[j]))).alias(f"v{i}_{j}") for i, j in pairs]]
        table = rows.groupBy("duration").agg(*sums, *own, *tied, F.count(F.lit(1)).alias("c")).fillna(0).toPandas().sort_values("duration", ascending=False)
        value, gradient, hessian = 0.0, np.zeros(p), np.zeros((p, p))
        s0, s1, s2 = 0.0, np.zeros(p), np.zeros((p, p))

        def square(r, k: str) -> np.ndarray:
            out = np.zeros((p, p))
            for i, j in pairs:
                out[i, j] = out[j, i] = r[f"{k}{i}_{j}"]
            return out

        for r in table.to_dict("records"):
            s0, s1, s2 = s0 + r["w"], s1 + [r[f"w{i}"] for i in range(p)], s2 + square(r, "w")
            if r["d"]:
                v1, v2 = np.array([r[f"v{i}"] for i in range(p)]), square(r, "v")
                logs, a, b, aa, ab, bb = efron_sums(s0, r["v"], int(r["d"]))
                value += r["s"] - logs
                gradient += [r[f"x{i}"] for i in range(p)] - (a * s1 - b * v1)
                crossed = np.outer(s1, v1)
                hessian += a * s2 - b * v2 - (aa * np.outer(s1, s1) - ab * (crossed + crossed.T) + bb * np.outer(v1, v1))
        covariance = np.linalg.pinv(hessian)
        model = CoxModel(names, beta.copy(), covariance, value, int(table["c"].sum()) if len(table) else 0, int(table["d"].sum()) if len(table) else 0)
        if value - last < tolerance * (abs(value) + 1):
            break
        last, beta = value, beta + covariance @ gradient
    return model


def cox_models(survival: DataFrame, covariates: Sequence[str], group: str = "project_type", indicator: str = "is_second", least: int = 100) -> DataFrame:
    """model, covariate, coef, ..., z, p_value, people, events, log_likelihood (partial) and concordance of the model with the group
    alone, of the full one, and of one for each group of over `least` people without what the group decides. `indicator` starts the names of covariates that hold the group."""
    inner = [c for c in covariates if c != indicator and not c.startswith(indicator.removeprefix("is_"))]
    parts = [("group", survival, [indicator]), ("full", survival, list(covariates))]
    sizes = survival.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).orderBy(group).collect()
    parts += [(r[group], survival.where(F.col(group) == r[group]), inner) for r in sizes]
    out = None
    for name, rows, names in parts:
        model = cox_ph(rows, names)
        index = concordance(model.risk(rows)).select(F.col("index").alias("concordance"))
        one = model.summary(survival.sparkSession).withColumn("model", F.lit(name)).withColumns({"people": F.lit(model.rows), "events": F.lit(model.events), "log_likelihood": F.lit(float(model.log_likelihood))}).crossJoin(index)  # one row
        out = one if out is None else out.unionByName(one)
    return out


def _few_times(rows: DataFrame) -> None:
    if rows.select("duration").distinct().limit(MOST_TIMES + 1).count() > MOST_TIMES:
        raise ValueError("too many distinct durations; round them first")


def baseline_hazard(model: CoxModel, survival: DataFrame) -> DataFrame:
    """duration, hazard (cumulative, Breslow)."""
    rows = model.risk(survival.select("duration", "event", *model.covariates).dropna())
    _few_times(rows)
    at = rows.groupBy("duration").agg(F.sum(F.exp("risk")).alias("w"), F.sum("event").alias("d"))
    # One row for each distinct duration.
    at = at.withColumn("risk_set", F.sum("w").over(Window.orderBy(F.desc("duration")).rowsBetween(Window.unboundedPreceding, 0)))
    return at.select("duration", F.sum(F.col("d") / F.col("risk_set")).over(Window.orderBy("duration").rowsBetween(Window.unboundedPreceding, 0)).alias("hazard"))


def cox_predict(model: CoxModel, survival: DataFrame, people: DataFrame, person: str = "person") -> DataFrame:
    """person, duration, survival of the given covariate rows, at most MOST_PEOPLE: exp(-H(t) exp(risk))."""
    few = model.risk(people).select(person, "risk")
    if few.limit(MOST_PEOPLE + 1).count() > MOST_PEOPLE:
        raise ValueError(f"curves for more than {MOST_PEOPLE} people; give them in parts")
    return baseline_hazard(model, survival).crossJoin(few).select(person, "duration", F.exp(-F.col("hazard") * F.exp("risk")).alias("survival"))


def ph_test(model: CoxModel, survival: DataFrame) -> DataFrame:
    """covariate, rho (correlation of the Schoenfeld residuals with the rank of the event time), chi2 = events * rho^2."""
    rows = model.risk(survival.select("duration", "event", *model.covariates).dropna()).withColumn("w", F.exp("risk"))
    _few_times(rows)
    at = rows.groupBy("duration").agg(F.sum("w").alias("w0"), *[F.sum(F.col("w") * F.col(c)).alias(f"w_{c}") for c in model.covariates])
    back = Window.orderBy(F.desc("duration")).rowsBetween(Window.unboundedPreceding, 0)
    mean = at.select("duration", F.row_number().over(Window.orderBy("duration")).alias("place"), *[(F.sum(f"w_{c}").over(back) / F.sum("w0").over(back)).alias(f"m_{c}") for c in model.covariates])
    hits = rows.where("event = 1").join(mean, "duration")
    out = hits.agg(F.count(F.lit(1)).alias("n"), *[correlation(F.col(c) - F.col(f"m_{c}"), F.col("place")).alias(c) for c in model.covariates])
    return out.unpivot(["n"], model.covariates, "covariate", "rho").select("covariate", "rho", (F.col("n") * F.col("rho") * F.col("rho")).alias("chi2"))


def concordance(rows: DataFrame, keys: Sequence[str] = (), score: str = "risk") -> DataFrame:
    """keys, pairs, concordant, tied, index: of pairs in which one has the event before the other's time, how often that one
    has the higher score (ties count half).

    Times become ranks. The later times of a rank r are the dyadic blocks (r >> l) + 1 on the levels l where bit l of r is 0,
    so each row meets a few blocks, and a running count over scores in each block does the rest: no pairs are made.
    """
    on = list(keys)
    times = rows.select(*on, "duration").distinct()
    _few_times(rows)
    times = times.withColumn("r", F.row_number().over(Window.partitionBy(*on, F.lit(0)).orderBy("duration")) - 1)
    levels = max(1, int(times.agg(F.max("r")).first()[0] or 0).bit_length())
    ranked = rows.select(*on, "duration", F.col("event"), F.col(score).alias("x")).join(times, [*on, "duration"])
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("l")
    shift = lambda: F.expr("shiftright(r, l)")
    data = ranked.select(*on, "r", "x", level).select(*on, "l", shift().alias("b"), "x", F.lit(1).alias("nd"), F.lit(0).alias("nq"))
    asks = ranked.where("event = 1").select(*on, "r", "x", level).where(F.expr("shiftright(r, l) % 2 = 0")).select(*on, "l", (shift() + 1).alias("b"), "x", F.lit(0).alias("nd"), F.lit(1).alias("nq"))
    cells = data.unionByName(asks).groupBy(*on, "l", "b", "x").agg(F.sum("nd").alias("nd"), F.sum("nq").alias("nq"))
    cells = running_sums(cells, [*on, "l", "b"], "x", ["nd"]).withColumnsRenamed({"nd_below": "below", "nd_all": "size"})
    out = cells.groupBy(*on).agg(F.sum(F.col("nq") * F.col("size")).alias("pairs"), F.sum(F.col("nq") * F.col("below")).alias("concordant"), F.sum(F.col("nq") * F.col("nd")).alias("tied"))
    return out.withColumn("index", (F.col("concordant") + F.col("tied") / 2) / F.when(F.col("pairs") > 0, F.col("pairs")))


def concordance_cv(survival: DataFrame, covariates: Sequence[str], person: Sequence[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """One row: mean and std of the concordance on held-out folds; folds by hash of the person."""
    rows = survival.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), *person), F.lit(folds)))
    parts = None
    for k in range(folds):
        model = cox_ph(rows.where(F.col("fold") != k), covariates)
        part = model.risk(rows.where(F.col("fold") == k)).select("fold", "duration", "event", "risk")
        parts = part if parts is None else parts.unionByName(part)
    return concordance(parts, ["fold"]).agg(F.avg("index").alias("mean"), F.stddev_pop("index").alias("std"), F.count(F.lit(1)).alias("folds"))


def survival_checks(survival: DataFrame, curve: DataFrame, group: str = "project_type") -> DataFrame:
    """check, ok for each rule on the survival table and its curve."""
    s = survival.agg(
        F.min(F.col("event").isin(0, 1)).alias("events_binary"),
        (F.min("duration") > 0).alias("durations_positive"),
        (F.count_distinct(group) >= 2).alias("both_groups"),
        F.avg("event").between(0.001, 0.999).alias("event_rate_plausible"),
        (F.max("duration") < 5200).alias("durations_plausible"),
    )
    c = curve.agg((F.min("survival").between(0, 1) & F.max("survival").between(0, 1)).alias("survival_in_range"), F.min(F.col("lower") <= F.col("upper")).alias("band_ordered"))
    wide = s.crossJoin(c)  # one row each
    return wide.unpivot([], wide.columns, "check", "ok")
