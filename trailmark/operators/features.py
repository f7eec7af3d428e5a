"""Features of early behaviour, from the weekly activity table and from commits.

activity: PERSON keys, week_number, week_date, commits_this_week, cumulative_lines_changed, rank_this_week,
contribution_percentage, files_modified_this_week and the like. Weeks of the dense grid follow each other without a gap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import count_if
from trailmark.operators.activity import PERSON
from trailmark.operators.stats import quantiles
from trailmark.operators.written import written


def _order():
    # Not a constant: a window can't be made before there is a session.
    return Window.partitionBy(*PERSON).orderBy("week_number")


def with_week_index(activity: DataFrame, first: int | None = None) -> DataFrame:
    """Adds i (weeks since the person's first, from 0) and lines_this_week (the cumulative lines' difference, if the table has these); with `first`, only
    the first so many weeks. A table with weeks_since_first has i already, and later weeks go before anything is sorted."""
    i = F.col("weeks_since_first") if "weeks_since_first" in activity.columns else F.col("week_number") - F.min("week_number").over(Window.partitionBy(*PERSON))
    rows = activity.withColumn("i", i)
    rows = rows if first is None else rows.where(F.col("i") < first)
    if "cumulative_lines_changed" not in activity.columns:
        return rows
    lines = F.col("cumulative_lines_changed") - F.lag("cumulative_lines_changed").over(_order())
    return rows.withColumn("lines_this_week", F.coalesce(lines, "cumulative_lines_changed"))


def pre_core(activity: DataFrame, transitions: DataFrame, min_commits: int = 3, min_weeks: int = 12) -> DataFrame:
    """The weeks before the first core week (all weeks of the others) of people with enough commits and such weeks, with
    label_became_core."""
    few = transitions.where(F.col("total_commits") >= min_commits).select(*PERSON, "first_core_week", F.col("became_core").alias("label_became_core"))
    # A row a person: sorted, as a broadcast would be the whole table on the driver.
    rows = activity.join(few.hint("merge"), list(PERSON)).where(F.col("first_core_week").isNull() | (F.col("week_number") < F.col("first_core_week")))
    return rows.withColumn("n_weeks", F.count(F.lit(1)).over(Window.partitionBy(*PERSON))).where(F.col("n_weeks") >= min_weeks).drop("first_core_week")


def pre_core_people(transitions: DataFrame, min_commits: int = 3, min_weeks: int = 12) -> DataFrame:
    """PERSON, label_became_core: the people of whom pre_core keeps weeks, from their journeys alone. A person has every week
    from the first to the last observed, so those before the first core week are counted by their numbers."""
    until = F.coalesce(F.col("first_core_week"), F.col("last_observed_week") + 1)
    enough = (F.col("total_commits") >= min_commits) & (until - F.col("first_commit_week") >= F.greatest(F.lit(min_weeks), F.lit(1)))
    return transitions.where(enough).select(*PERSON, F.col("became_core").alias("label_became_core"))


def early_window_features(activity: DataFrame, windows: Sequence[int] = (4, 8, 12)) -> DataFrame:
    """PERSON, w<n>_ total_commits, total_lines, total_files, active_weeks, consistency, avg, max, std, burst_ratio, slope,
    r2, rank_start, rank_end, rank_improvement, pct_end over the first n weeks. One aggregate makes all windows."""
    rows = with_week_index(activity, max(windows))
    c, i = F.col("commits_this_week"), F.col("i")
    out = []
    for n in windows:
        inside = i < n
        when = lambda x, inside=inside: F.when(inside, x)
        active = F.when(inside & (c > 0), c)
        flat = F.coalesce(F.stddev_pop(when(c)), F.lit(0.0)) == 0
        mean, most = F.coalesce(F.avg(active), F.lit(0.0)), F.coalesce(F.max(active), F.lit(0))
        parts = {
            "total_commits": F.sum(when(c)),
            "total_lines": F.sum(when(F.col("lines_this_week"))),
            "total_files": F.sum(when(F.col("files_modified_this_week"))),
            "active_weeks": F.count(active),
            "consistency": F.count(active) / float(n),
            "avg_commits": mean,
            "max_commits": most,
            "std_commits": F.coalesce(F.stddev_samp(active), F.lit(0.0)),
            "burst_ratio": F.when(mean > 0, most / mean).otherwise(F.lit(0.0)),
            "trend_slope": F.when(flat, F.lit(0.0)).otherwise(F.regr_slope(when(c), when(i))),
            "trend_r2": F.when(flat, F.lit(0.0)).otherwise(F.regr_r2(when(c), when(i))),
            "rank_start": F.min_by("rank_this_week", i),
            "rank_end": F.max_by(when(F.col("rank_this_week")), when(i)),
            "pct_end": F.max_by(when(F.col("contribution_percentage")), when(i)),
        }
        out += [v.alias(f"w{n}_{k}") for k, v in parts.items()]
    wide = rows.groupBy(*PERSON).agg(*out)
    return wide.withColumns({f"w{n}_rank_improvement": F.col(f"w{n}_rank_start") - F.col(f"w{n}_rank_end") for n in windows})


def first_week_features(activity: DataFrame) -> DataFrame:
    """PERSON, first_commits, first_lines, first_rank, first_pct."""
    rows = with_week_index(activity, 1)
    return rows.select(*PERSON, F.col("commits_this_week").alias("first_commits"), F.col("lines_this_week").alias("first_lines"), F.col("rank_this_week").alias("first_rank"), F.col("contribution_percentage").alias("first_pct"))


def inactive_streaks(activity: DataFrame, weeks: int | None = None) -> DataFrame:
    """PERSON, longest_inactive_streak, num_inactive_streaks (runs of weeks without commits), in the first `weeks` weeks."""
    rows = with_week_index(activity, weeks or None)
    # Idle weeks of one run share the difference of their week and their place among the idle weeks.
    idle = rows.where("commits_this_week = 0").withColumn("run", F.col("i") - F.row_number().over(_order()))
    runs = idle.groupBy(*PERSON, "run").agg(F.count(F.lit(1)).alias("k")).groupBy(*PERSON).agg(F.max("k").alias("longest_inactive_streak"), F.count(F.lit(1)).alias("num_inactive_streaks"))
    return rows.select(*PERSON).distinct().join(runs, list(PERSON), "left").fillna(0)


def active_gap_stats(activity: DataFrame) -> DataFrame:
    """PERSON, avg_gap, max_gap, std_gap (population) between active weeks, regularity 1 / (1 + std); 0 with fewer than two."""
    active = F.when(F.col("commits_this_week") > 0, F.col("week_number"))
    before = F.last(active, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    rows = activity.select(*PERSON, (active - before).alias("gap"))
    gaps = rows.groupBy(*PERSON).agg(F.avg("gap").alias("avg_gap"), F.max("gap").alias("max_gap"), F.stddev_pop("gap").alias("std_gap"))
    return gaps.withColumn("regularity", 1 / (1 + F.col("std_gap"))).fillna(0)


def acceleration(activity: DataFrame) -> DataFrame:
    """PERSON, acceleration (weeks 9-12 over weeks 1-4 plus one) and front_loaded; 1 and false with fewer than 12 weeks."""
    rows = with_week_index(activity)
    part = lambda a, b: F.sum(F.when(F.col("i").between(a, b), F.col("commits_this_week")).otherwise(0))
    out = rows.groupBy(*PERSON).agg(F.count(F.lit(1)).alias("n"), part(0, 3).alias("early"), part(8, 11).alias("late"))
    return out.select(*PERSON, F.when(F.col("n") >= 12, F.col("late") / (F.col("early") + 1)).otherwise(F.lit(1.0)).alias("acceleration"), ((F.col("n") >= 12) & (F.col("early") > F.col("late"))).alias("front_loaded"))


def features_90d_commits(commits: DataFrame, days: int = 90) -> DataFrame:
    """PERSON and features of the first `days` days: commits, lines, files, active days, span, commits a day, max and std of
    a day, months 1 to 3, early and late share, gap mean, max and consistency."""
    rows = commits.withColumn("born", F.min("commit_date").over(Window.partitionBy(*PERSON)))
    rows = rows.withColumn("day", F.datediff("commit_date", "born")).where(F.col("day") <= days)
    each = rows.groupBy(*PERSON, "day").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("total_insertions") + F.col("total_deletions")).alias("lines"), F.sum("files_modified_count").alias("files"))
    each = each.withColumn("gap", F.col("day") - F.lag("day").over(Window.partitionBy(*PERSON).orderBy("day")))
    month = lambda a, b: F.sum(F.when((F.col("day") >= a) & (F.col("day") < b), F.col("c")).otherwise(0))
    n = F.sum("c")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return each.groupBy(*PERSON).agg(
        n.alias("commits_90d"),
        F.sum("lines").alias("lines_90d"),
        F.sum("files").alias("files_90d"),
        F.count(F.lit(1)).alias("active_days"),
        (F.max("day") - F.min("day")).alias("span_days"),
        (n / F.count(F.lit(1))).alias("commits_per_active_day"),
        F.max("c").alias("max_commits_day"),
        zero(F.stddev_samp("c")).alias("std_commits_day"),
        month(0, 30).alias("month1"),
        month(30, 60).alias("month2"),
        month(60, days + 1).alias("month3"),
        (month(0, 30) / n).alias("early_share"),
        (month(60, days + 1) / n).alias("late_share"),
        zero(F.avg("gap")).alias("gap_mean"),
        F.coalesce(F.max("gap"), F.lit(0)).alias("gap_max"),
        (1 / (1 + zero(F.stddev_samp("gap")))).alias("gap_consistency"),
    )


def features_13w_activity(activity: DataFrame) -> DataFrame:
    """PERSON and features of the first 13 weeks: rate, regularity 1 / (1 + cv), months of 4, 4 and 5 weeks, growth between
    them, sustained growth, early/late ratio, productivity against the project's median."""
    rows = with_week_index(activity, 13)
    c = F.col("commits_this_week")
    part = lambda a, b: F.sum(F.when(F.col("i").between(a, b), c).otherwise(0))
    cv = F.stddev_pop(c) / F.avg(c)
    out = rows.groupBy(*PERSON).agg(
        (count_if(c > 0) / F.count(F.lit(1))).alias("activity_rate_13w"),
        F.coalesce(1 / (1 + cv), F.lit(0.0)).alias("regularity_13w"),
        F.sum(c).alias("commits_13w"),
        part(0, 3).alias("month1"),
        part(4, 7).alias("month2"),
        part(8, 12).alias("month3"),
    )
    out = out.withColumn("acceleration_13w", (F.col("month3") + 1) / (F.col("month1") + 1)).withColumn("sustained_growth", (F.col("month1") < F.col("month2")) & (F.col("month2") < F.col("month3")))
    out = out.withColumn("early_late_ratio", (F.col("month1") + 1) / (F.col("month3") + 1))
    typical = out.groupBy("project_name").agg(F.percentile("commits_13w", F.lit(0.5)).alias("typical"))
    return out.join(typical, "project_name").withColumn("productivity", F.col("commits_13w") / F.greatest("typical", F.lit(1.0))).drop("typical")


def core_label_match(monthly: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, unmatched). labels: project_name, author_email and first_core_month (null if never core); unmatched: core
    people of the monthly table without a commit. monthly: project_name, month and the core, as an array or a person
    (author_email) a row."""
    keys = ["project_name", "author_email"]
    rows = monthly if "author_email" in monthly.columns else monthly.select("project_name", F.explode("core").alias("author_email"), "month")
    core = written(rows.groupBy(*keys).agg(F.min("month").alias("first_core_month")))  # read by both results
    people = written(commits.select(*keys).distinct())
    return people.join(core.hint("merge"), keys, "left"), core.join(people.hint("merge"), keys, "left_anti")


def numeric_features(frame: DataFrame, drop: Sequence[str] = ()) -> list[str]:
    """Names of numeric columns with more than one distinct value, without ids and leaking columns."""
    kinds = ("int", "bigint", "smallint", "tinyint", "double", "float")
    names = [c for c, k in frame.dtypes if k in kinds and c not in drop]
    if not names:
        return []
    # A null counts as a value of its own.
    varies = frame.agg(*[((F.min(c) < F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1))))).alias(c) for c in names]).first()
    return [c for c in names if varies[c]]


def feature_matrix(frame: DataFrame, ids: Sequence[str], label: str, drop: Sequence[str] = ()) -> DataFrame:
    """ids, label and the numeric features (see numeric_features; ids, label and `drop` aren't features), nulls replaced by the
    feature's median, then brought to mean 0 and population deviation 1 (0 for a feature that is flat by then).

    Medians come from counts of values, means and deviations from one aggregate; both are one row.
    """
    names = numeric_features(frame, [*ids, label, *drop])
    if not names:
        return frame.select(*ids, label)
    rows = frame.select(*ids, label, *[F.col(c).cast("double").alias(c) for c in names])
    medians = quantiles(rows.select(*names).unpivot([], names, "metric", "x"), ["metric"], "x", {"m": 0.5}).collect()  # a row a feature
    fill = {r["metric"]: r["m"] for r in medians}
    rows = rows.fillna({c: fill[c] for c in names if c in fill})
    scale = rows.agg(*[f(c).alias(f"{k}_{c}") for c in names for k, f in (("mean", F.avg), ("sd", F.stddev_pop))]).first()
    return rows.select(*ids, label, *[((F.col(c) - scale[f"mean_{c}"]) / scale[f"sd_{c}"] if scale[f"sd_{c}"] else F.lit(0.0)).alias(c) for c in names])
