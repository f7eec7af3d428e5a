"""Weekly contribution series: metrics, index, resampling, clustering, and life-cycle stages.

A person's series is an array of doubles in one row, so shapes are changed without a shuffle: by array expressions, or by
numpy over Arrow batches where every point of the result reads the whole array (nested array expressions, which Catalyst
puts into one another, worked the array out anew for each point: a query of seconds did not end in minutes).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import count_if
from trailmark.operators.kmeans import assigned, fit_kmeans
from trailmark.operators.medoids import medoids
from trailmark.operators.stats import on_keys, quantiles
from trailmark.operators.written import spread, written

KEYS = ("person",)
#: Weights of the contribution index.
WEIGHTS = {"commits": 0.25, "prs_merged": 0.20, "comments": 0.15, "issues_opened": 0.15, "active_days": 0.15, "duration": 0.10}


def _active_weeks(events: DataFrame, keys: Sequence[str], comments: DataFrame | None) -> DataFrame:
    """keys, event_week, the metrics, and event (an event lies in the week, not comments alone): a row for each week with either."""
    kind, day = F.col("event_type"), F.to_date("event_timestamp")
    said = comments.schema["comments"].dataType if comments is not None else "bigint"
    own = F.col("comments") if "comments" in events.columns else F.lit(0).cast(said)
    rows = events.select(*keys, "event_week", "event_type", "pr_state", "event_timestamp", own.alias("comments"), F.lit(True).alias("event"))
    if comments is not None:
        none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
        rows = rows.unionByName(comments.select(*keys, "event_week", none("event_type"), none("pr_state"), none("event_timestamp"), "comments", F.lit(False).alias("event")))
    return rows.where("event_week is not null").groupBy(*keys, "event_week").agg(
        count_if(kind == "commit").alias("commits"),
        count_if((kind == "pull_request") & (F.col("pr_state") == "merged")).alias("prs_merged"),
        count_if(kind == "issue").alias("issues_opened"),
        F.least(F.count_distinct(day), F.lit(7)).alias("active_days"),
        F.coalesce(F.sum("comments"), F.lit(0)).alias("comments"),
        F.max("event").alias("event"),
    )


def _known(keys: Sequence[str]) -> Column:
    """Weeks without an id count for nothing, as a join on it leaves them out."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return known


def weekly_contribution_metrics(events: DataFrame, keys: Sequence[str] = KEYS, comments: DataFrame | None = None) -> DataFrame:
    """A row for each week from a person's first to last event: commits, prs_merged, comments, issues_opened, active_days.

    events: keys, event_week, event_type, pr_state, event_timestamp. comments: keys, event_week, comments (the person's own
    comments and reviews); they may also be a column of the events, to save the second pass; without either they are 0.

    Each active week is followed by its idle ones, in as many tasks as the session shuffles into, dealt by person: the weeks are
    neither joined nor shuffled, here or in a window by person.
    """
    person, week = Window.partitionBy(*keys), F.col("event_week")
    own = F.when(F.col("event"), week)
    rows = spread(_active_weeks(events, keys, comments), *keys).withColumn("a", F.min(own).over(person)).withColumn("b", F.max(own).over(person)).where(week.between(F.col("a"), F.col("b")))
    rows = rows.withColumn("until", F.coalesce(F.lead("event_week").over(person.orderBy("event_week")), F.col("b") + 1))
    rows = rows.select("*", F.explode(F.sequence(week, F.col("until") - 1)).alias("week_num"))
    count = lambda c: F.when(_known(keys) & (F.col("week_num") == week), F.col(c)).otherwise(F.lit(0)).alias(c)
    return rows.select(*keys, "week_num", *[count(c) for c in ("commits", "prs_merged", "issues_opened", "active_days", "comments")])


def with_duration(weekly: DataFrame, method: str = "rolling_4week", keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds duration by one of rolling_4week, rolling_8week, cumulative_ratio, binary, weeks_since_start."""
    active = F.when(F.col("commits") + F.col("prs_merged") + F.col("comments") + F.col("issues_opened") > 0, 1.0).otherwise(0.0)
    order = Window.partitionBy(*keys).orderBy("week_num")
    if method in ("rolling_4week", "rolling_8week"):
        n = int(method[8])
        value = F.sum(active).over(order.rowsBetween(-(n - 1), 0)) / float(n)
    elif method == "cumulative_ratio":
        value = F.avg(active).over(order.rowsBetween(Window.unboundedPreceding, 0))
    elif method == "binary":
        value = active
    elif method == "weeks_since_start":
        value = F.row_number().over(order) / F.count(F.lit(1)).over(Window.partitionBy(*keys))
    else:
        raise ValueError(f"no such duration: {method}")
    return weekly.withColumn("duration", value)


def contribution_index(days: float = 7.0) -> Column:
    """The weighted sum of a row's metrics; active days are taken as a share of `days`."""
    parts = [w * (F.col("active_days") / days if c == "active_days" else F.col(c)) for c, w in WEIGHTS.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def with_index(weekly: DataFrame) -> DataFrame:
    return weekly.withColumn("active_days_norm", F.col("active_days") / 7.0).withColumn("contribution_index", contribution_index())


def monthly_contribution(weekly: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, month_num (four weeks each), sums of the metrics, mean duration, and the index with days out of 28."""
    sums = [F.sum(c).alias(c) for c in ("commits", "prs_merged", "comments", "issues_opened", "active_days")]
    out = weekly.groupBy(*keys, F.floor(F.col("week_num") / 4).cast("int").alias("month_num")).agg(*sums, F.avg("duration").alias("duration"))
    return out.withColumn("contribution_index", contribution_index(28.0))


def as_series(weekly: DataFrame, value: str = "contribution_index", keys: Sequence[str] = KEYS, length: int | None = None) -> DataFrame:
    """keys, series: the values of weeks 0 to the last (or to length - 1), 0 where there is none.

    One row a person in an array instead of a column a week, so long histories need no wide schema.
    """
    pairs = F.map_from_entries(F.collect_list(F.struct("week_num", F.col(value).cast("double"))))
    grouped = weekly.groupBy(*keys).agg(pairs.alias("m"), F.max("week_num").alias("last"))
    stop = F.lit(length - 1) if length else F.col("last")
    return grouped.select(*keys, F.transform(F.sequence(F.lit(0), stop), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("series"))


def contribution_series(events: DataFrame, keys: Sequence[str] = KEYS, comments: DataFrame | None = None, window: int = 4) -> DataFrame:
    """keys, series: the contribution index of weeks 0 to the last, with the rolling duration of `window` weeks; the rows of
    as_series(with_index(with_duration(weekly_contribution_metrics(...)))) for weeks from 0, without a row for each week.

    A person's active weeks are gathered, and the array is made from them in one go. Comments outside the weeks from the first to
    the last event are left out, as the grid leaves them out.
    """
    weekly = _active_weeks(events, keys, comments)
    active = F.col("commits") + F.col("prs_merged") + F.col("comments") + F.col("issues_opened") > 0
    weekly = weekly.withColumn("duration", F.lit(0.0))
    known = _known(keys)
    point = F.struct(F.col("event_week").alias("week"), F.when(known, contribution_index()).otherwise(F.lit(0.0)).alias("x"), (known & active).alias("active"), "event")
    grouped = weekly.groupBy(*keys).agg(F.collect_list(point).alias("points")).where(F.exists("points", lambda p: p["event"]))
    part = lambda name: F.transform("points", lambda p: p[name])

    @F.pandas_udf("array<double>")
    def filled(week: pd.Series, x: pd.Series, active: pd.Series, event: pd.Series) -> pd.Series:
        out = []
        for w, v, a, e in zip(week, x, active, event, strict=True):
            w, e = np.asarray(w), np.asarray(e, bool)
            first, last = w[e].min(), w[e].max()
            inside = (w >= first) & (w <= last)
            series, busy = np.zeros(max(last + 1, 0)), np.zeros(last - first + 1)
            at = w[inside] - first
            busy[at] = np.asarray(a, bool)[inside]
            own = np.zeros(last - first + 1)
            own[at] = np.asarray(v, float)[inside]
            sums = np.append(0.0, np.cumsum(busy))
            place = np.arange(len(busy))
            own = own + WEIGHTS["duration"] * ((sums[place + 1] - sums[np.maximum(place + 1 - window, 0)]) / window)
            series[max(first, 0) :] = own[max(-first, 0) :]
            out.append(series)
        return pd.Series(out)

    return grouped.select(*keys, filled(part("week"), part("x"), part("active"), part("event")).alias("series"))


def series_lengths(series: DataFrame, keys: Sequence[str] = KEYS, *more: str) -> DataFrame:
    """keys, length, active_weeks, first_active, last_active, span of activity (0 and nulls without any), and `more` columns."""

    @F.pandas_udf("active_weeks int, first_active int, last_active int")
    def marks(values: pd.Series) -> pd.DataFrame:
        at = [np.flatnonzero(np.asarray(x, float)) for x in values]
        ends = lambda i: pd.array([int(a[i]) if len(a) else None for a in at], dtype="Int32")
        return pd.DataFrame({"active_weeks": [len(a) for a in at], "first_active": ends(0), "last_active": ends(-1)})

    out = series.select(*keys, *more, F.size("series").alias("length"), marks("series").alias("m"))
    first, last = F.col("m.first_active"), F.col("m.last_active")
    return out.select(*keys, "length", F.col("m.active_weeks").alias("active_weeks"), first.alias("first_active"), last.alias("last_active"), F.coalesce(last - first + 1, F.lit(0)).alias("span"), *more)


def length_percentiles(lengths: DataFrame, percents: Sequence[int] = (25, 50, 75, 90, 95), short: int = 20) -> DataFrame:
    """One row: people, p25 ... p95 of the length, and how many have at most `short` weeks."""
    q = F.percentile("length", F.array(*[F.lit(p / 100) for p in percents]))
    out = lengths.agg(F.count(F.lit(1)).alias("people"), q.alias("q"), count_if(F.col("length") <= short).alias("short"))
    return out.select("people", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate(percents)], "short")


def trim_active_segment(series: DataFrame, least: int = 6) -> DataFrame:
    """series cut to first..last non-zero value, and active (non-zero values); people with fewer than `least` of these go."""

    @F.pandas_udf("series array<double>, active int")
    def cut(values: pd.Series) -> pd.DataFrame:
        out, active = [], []
        for x in values:
            x = np.asarray(x, float)
            at = np.flatnonzero(x)
            out.append(x[at[0] : at[-1] + 1] if len(at) >= least and len(at) else None)
            active.append(len(at))
        return pd.DataFrame({"series": pd.Series(out, dtype=object), "active": pd.Series(active, dtype="int32")})

    others = [c for c in series.columns if c != "series"]
    return series.select(*others, cut("series").alias("_cut")).select(*others, "_cut.*").where("series is not null")


def resample_series(series: DataFrame, length: int = 52, sparse: int = 10) -> DataFrame:
    """The trimmed series at `length` evenly spaced points: linear, or the nearest value where a series of fewer than
    `sparse` active values is stretched (halves go down). Negative values become 0; series of one point stay flat."""

    @F.pandas_udf("array<double>")
    def points(values: pd.Series, active: pd.Series) -> pd.Series:
        out = []
        for x, k in zip(values, active, strict=True):
            x = np.asarray(x, float)
            at = np.arange(length) * (len(x) - 1) / (length - 1)
            if len(x) < length and k < sparse:
                y = x[np.clip(np.ceil(at - 0.5).astype(int), 0, len(x) - 1)]
            else:
                y = np.interp(at, np.arange(len(x)), x)
            out.append(np.maximum(y, 0.0))
        return pd.Series(out)

    return series.withColumn("series", points("series", "active"))


def scale_series(series: DataFrame, method: str = "minmax") -> DataFrame:
    """Each series to 0..1 (flat ones to 0), or to mean 0 and population deviation 1."""

    @F.pandas_udf("array<double>")
    def scaled(values: pd.Series) -> pd.Series:
        out = []
        for x in values:
            x = np.asarray(x, float)
            base, width = (x.min(), x.max() - x.min()) if method == "minmax" else (x.mean(), x.std())
            out.append((x - base) / width if width > 1e-12 else np.zeros(len(x)))
        return pd.Series(out)

    return series.withColumn("series", scaled("series"))


def _points(series: DataFrame, column: str) -> DataFrame:
    return written(series.where(F.col(column).isNotNull()).withColumn(column, F.col(column).cast("array<double>")))


def _best(runs: dict, k: int) -> tuple[np.ndarray, float]:
    return min((runs[r] for r in sorted(runs) if r[0] == k), key=lambda run: run[1])


def kmeans_series(series: DataFrame, k: int = 3, restarts: int = 10, column: str = "series", seed: int = 42) -> DataFrame:
    """Adds cluster by Euclidean k-means, the run with the least cost of all restarts; see fit_kmeans. Rows without a series go."""
    rows = _points(series, column)
    runs = fit_kmeans(rows, column, [k], restarts, seed)
    return assigned(rows, column, [_best(runs, k)[0]] if runs else [np.zeros((1, 1))], "_c").withColumn("cluster", F.col("_c")[0]).drop("_c")


def kmeans_sweep(series: DataFrame, keys: Sequence[str] = KEYS, ks: Sequence[int] = (2, 3, 4, 5, 6), restarts: int = 10, column: str = "series", seed: int = 42) -> DataFrame:
    """k, cost (least of the restarts), silhouette (mean, on squared distances) for each number of clusters, all fitted in the
    same passes and judged in one."""
    rows = _points(series.select(*keys, column), column)
    runs = fit_kmeans(rows, column, ks, restarts, seed)
    if not runs:
        return series.sparkSession.createDataFrame([], "k int, cost double, silhouette double")
    best = {k: _best(runs, k) for k in ks}
    labels = assigned(rows, column, [best[k][0] for k in ks], "_c").select(*keys, column, F.posexplode("_c").alias("_i", "cluster"))
    labels = labels.withColumn("k", F.array(*[F.lit(k) for k in ks])[F.col("_i")])
    costs = series.sparkSession.createDataFrame([(k, best[k][1]) for k in ks], "k int, cost double")
    return costs.join(silhouette_rows(labels, [*keys, "k"], column, ["k"]).groupBy("k").agg(F.avg("silhouette").alias("silhouette")), "k")


def kmeans_labelings(series: DataFrame, k: int = 3, seeds: int = 5, column: str = "series", seed: int = 42) -> DataFrame:
    """Adds labelings: the cluster by each of so many single runs from different starts, fitted in the same passes."""
    rows = _points(series, column)
    runs = fit_kmeans(rows, column, [k], seeds, seed)
    return assigned(rows, column, [runs[k, r][0] for r in range(seeds)] if runs else [], "labelings")


def silhouette_rows(clusters: DataFrame, keys: Sequence[str] = KEYS, column: str = "series", within: Sequence[str] = ()) -> DataFrame:
    """keys, cluster, silhouette of each row on squared Euclidean distances, without pairs. within: columns, of the keys, that tell
    several labelings apart.

    The mean squared distance to a cluster follows from its size, its sum and its sum of squares; these are one row a
    cluster, so they are broadcast.
    """
    on = [*within, "cluster"]
    rows = clusters.select(*keys, "cluster", F.col(column).cast("array<double>").alias("x"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    rows = rows.withColumn("xx", dot(F.col("x"), F.col("x")))
    parts = rows.select(*on, F.posexplode("x").alias("i", "v")).groupBy(*on, "i").agg(F.sum("v").alias("s"))
    sums = parts.groupBy(*on).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda e: e["s"]).alias("sum"))
    stats = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.sum("xx").alias("squares")).join(sums, on)
    stats = F.broadcast(stats.select(*within, F.col("cluster").alias("other"), "n", "squares", "sum"))  # a row for each cluster
    both = rows.join(stats, list(within)) if within else rows.crossJoin(stats)
    total = F.col("n") * F.col("xx") - 2 * dot(F.col("x"), F.col("sum")) + F.col("squares")
    own = F.col("other") == F.col("cluster")
    dist = both.groupBy(*keys, "cluster").agg(
        F.max(F.when(own & (F.col("n") > 1), total / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, total / F.col("n"))).alias("b"),
    )
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise(F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(F.lit(0.0)))
    return dist.select(*keys, "cluster", value.alias("silhouette"))


def cluster_quality(clusters: DataFrame, keys: Sequence[str] = KEYS, column: str = "series", labelings: str | None = None) -> DataFrame:
    """One row: mean_silhouette, negative_share, davies_bouldin, size_balance (smallest over largest cluster) and, with a column
    `labelings` (see kmeans_labelings), stability: the mean adjusted Rand index of its pairs."""
    sil = silhouette_rows(clusters, keys, column).agg(F.avg("silhouette").alias("mean_silhouette"), F.avg(F.when(F.col("silhouette") < 0, 1.0).otherwise(0.0)).alias("negative_share"))
    rows = clusters.select("cluster", F.col(column).cast("array<double>").alias("x"))
    center = rows.select("cluster", F.posexplode("x").alias("i", "v")).groupBy("cluster", "i").agg(F.avg("v").alias("m"))
    center = center.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("c"))
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v))
    spread = rows.join(F.broadcast(center), "cluster").groupBy("cluster", "c").agg(F.avg(gap(F.col("x"), F.col("c"))).alias("s"), F.count(F.lit(1)).alias("n"))
    a, b = spread.select(F.col("cluster").alias("i"), F.col("c").alias("ci"), F.col("s").alias("si")), spread.select(F.col("cluster").alias("j"), F.col("c").alias("cj"), F.col("s").alias("sj"))
    worst = a.join(b, F.col("i") != F.col("j")).groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / gap(F.col("ci"), F.col("cj"))).alias("r"))
    out = sil.crossJoin(worst.agg(F.avg("r").alias("davies_bouldin"))).crossJoin(spread.agg((F.min("n") / F.max("n")).alias("size_balance")))  # one row each
    return out.crossJoin(rand_of_pairs(clusters, labelings).agg(F.avg("rand").alias("stability"))) if labelings else out


def rand_of_pairs(labels: DataFrame, column: str = "labelings") -> DataFrame:
    """first, second, rand: the adjusted Rand index of each pair of a row's labelings (numbers from 0), from the contingency counts
    of all pairs, which one pass makes."""
    with_place = F.transform(column, lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    one, other = labels.select(with_place.alias("a")).withColumn("b", F.col("a")), F.explode("b").alias("q")
    pairs = one.select(F.explode("a").alias("p"), "b").select("p", other).where("p.i < q.i")
    cells = pairs.groupBy(F.col("p.i").alias("first"), F.col("q.i").alias("second"), F.col("p.v").alias("x"), F.col("q.v").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    cells = written(cells)
    two = lambda c: c * (c - 1) / 2
    side = lambda c, name: cells.groupBy("first", "second", c).agg(F.sum("n").alias("m")).groupBy("first", "second").agg(F.sum(two(F.col("m"))).alias(name))
    row = cells.groupBy("first", "second").agg(F.sum(two(F.col("n"))).alias("both"), F.sum("n").alias("n")).join(side("x", "a"), ["first", "second"]).join(side("y", "b"), ["first", "second"])
    chance = F.col("a") * F.col("b") / F.when(F.col("n") > 1, two(F.col("n")))
    top = (F.col("a") + F.col("b")) / 2
    return row.select("first", "second", F.when(chance.isNull() | (top == chance), F.lit(1.0)).otherwise((F.col("both") - chance) / (top - chance)).alias("rand"))


def adjusted_rand(labels: DataFrame, first: str, second: str) -> DataFrame:
    """One row: rand, the adjusted Rand index of two labelings, from their contingency counts."""
    cells = labels.groupBy(first, second).agg(F.count(F.lit(1)).cast("double").alias("n"))
    two = lambda c: c * (c - 1) / 2
    both = cells.agg(F.sum(two(F.col("n"))).alias("both"), F.sum("n").alias("n"))
    side = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(two(F.col("m"))).alias(name))
    row = both.crossJoin(side(first, "a")).crossJoin(side(second, "b"))
    chance = F.col("a") * F.col("b") / two(F.col("n"))
    top = (F.col("a") + F.col("b")) / 2
    return row.select(F.when(top == chance, F.lit(1.0)).otherwise((F.col("both") - chance) / (top - chance)).alias("rand"))


def median_centroid(clusters: DataFrame, column: str = "series") -> DataFrame:
    """cluster, centroid: the median of each position."""
    rows = clusters.select("cluster", F.posexplode(F.col(column).cast("array<double>")).alias("i", "v"))
    each = on_keys(rows.select("cluster", "i").distinct(), quantiles(rows, ["cluster", "i"], "v", {"m": 0.5}), ["cluster", "i"])
    return each.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("centroid"))


def pattern_label(centroid: Column) -> Column:
    """early_burst (peak before 10), late_bloomer (peak after 35), growing or declining (halves apart by 1.5), sustained
    (population deviation under 0.1), else intermittent; positions from 0."""
    n = F.size(centroid)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    half = F.floor(n / 2).cast("int")
    first = total(F.slice(centroid, F.lit(1), half)) / half
    second = total(F.slice(centroid, half + 1, n - half)) / (n - half)
    peak = F.array_position(centroid, F.array_max(centroid)) - 1
    mean = total(centroid) / n
    sd = F.sqrt(F.greatest(F.lit(0.0), total(F.transform(centroid, lambda x: x * x)) / n - mean * mean))
    return F.when(peak < 10, "early_burst").when(peak > 35, "late_bloomer").when(second > first * 1.5, "growing").when(first > second * 1.5, "declining").when(sd < 0.1, "sustained").otherwise("intermittent")


def medoid(clusters: DataFrame, keys: Sequence[str] = KEYS, column: str = "series") -> DataFrame:
    """cluster, keys of the member with the least summed Euclidean distance to its cluster (ties to the smallest key); exact,
    without pairs: see medoids."""
    return medoids(clusters, keys, column)[0].select("cluster", *keys)


def cluster_weeks_to_core(clusters: DataFrame, series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, cluster, weeks (last minus first active week) and the summed index, of people in both tables."""
    lengths = series_lengths(series, keys, "series").where("active_weeks > 0")
    total = F.aggregate("series", F.lit(0.0), lambda t, x: t + x)
    both = lengths.select(*keys, (F.col("last_active") - F.col("first_active")).alias("weeks"), total.alias("total_index"))
    # A row a person on either side: sorted, as a broadcast would be the whole table on the driver.
    return clusters.select(*keys, "cluster").join(both.hint("merge"), list(keys))


def cluster_journey_join(clusters: DataFrame, transitions: DataFrame, person: str = "person", email: str = "author_email") -> DataFrame:
    """Cluster members with their core journeys, on the lower-cased id: weeks from weeks_to_core, else from core and first
    week, else the time to event."""
    t = transitions.where("became_core").withColumn("k", F.lower(F.trim(F.col(email))))
    weeks = F.coalesce("weeks_to_core", F.col("first_core_week") - F.col("first_commit_week"), "time_to_event_weeks")
    return clusters.withColumn("k", F.lower(F.trim(F.col(person)))).join(t, "k").select(person, "cluster", "project_name", weeks.alias("weeks"))


def group_time_stats(rows: DataFrame, keys: Sequence[str], value: str = "weeks") -> DataFrame:
    """keys, n, median, mean, std, q25, q75, min, max."""
    v = F.col(value).cast("double")
    out = rows.where(v.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    out = on_keys(out, quantiles(rows, keys, value, {"median": 0.5, "q25": 0.25, "q75": 0.75}), keys)
    return out.select(*keys, "n", "median", "mean", "std", "q25", "q75", "min", "max")


def lifecycle_stage(commits: DataFrame, project: str = "project_name", ts: str = "commit_date", bounds: Sequence[tuple[str, int]] = (("early", 7), ("middle", 10), ("late", 13))) -> DataFrame:
    """Adds stage: early to year 7, middle to 10, late to 13 of the project. A stage is kept where the project is as old as
    its end (in years of 365 days); commits outside kept stages go."""
    whole = Window.partitionBy(project)
    rows = commits.withColumn("born", F.min(ts).over(whole))
    rows = rows.withColumn("years", F.floor((F.unix_seconds(F.max(ts).over(whole)) - F.unix_seconds("born")) / 86400) / 365.0)
    stage = F.lit(None).cast("string")
    for name, years in reversed(bounds):
        inside = F.col(ts) < F.col("born") + F.make_interval(years=F.lit(years))
        stage = F.when(inside, F.when(F.col("years") >= years, name)).otherwise(stage)
    return rows.withColumn("stage", stage).where("stage is not null").drop("born", "years")


def core_churn_ratio(staged: DataFrame, project: str = "project_name", ts: str = "commit_date", churn: str = "churn", core: str = "is_core") -> DataFrame:
    """project, stage, month, churn, core_churn, core_churn_ratio; months without churn go."""
    out = staged.groupBy(project, "stage", F.date_format(ts, "yyyy-MM").alias("month")).agg(F.sum(churn).alias("churn"), F.sum(F.when(F.col(core), F.col(churn)).otherwise(0)).alias("core_churn"))
    return out.where("churn <> 0").withColumn("core_churn_ratio", F.col("core_churn") / F.col("churn"))


def stage_cluster_mix(rows: DataFrame, stage: str = "stage", category: str = "project_type") -> DataFrame:
    """stage, category, cluster, n and percent of the stage and category."""
    counts = rows.groupBy(stage, category, "cluster").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(stage, category)))

