"""Checks of tables: a row for each rule with the number of violations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import count_if
from trailmark.operators.activity import PERSON
from trailmark.operators.core import contributor_counts

#: What the checks read of a weekly activity table, and the number of weeks that a row stands for.
RUNS = "project_name string, project_type string, author_email string, week_number int, week_date date, commits_this_week bigint, cumulative_commits bigint, is_core_this_week boolean, outside boolean, weeks bigint"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, those that only go on from the row before counted in its `weeks`. A null never goes on."""
    for batch in batches:
        if not batch.num_rows:
            continue
        new, old = batch.slice(1), batch.slice(0, batch.num_rows - 1)
        step = lambda c, kind: pc.subtract(new.column(c).cast(kind), old.column(c).cast(kind))
        tests = [pc.equal(new.column(c), old.column(c)) for c in (*PERSON, "cumulative_commits", "is_core_this_week", "outside")]
        tests += [pc.equal(step("week_number", pa.int64()), 1), pc.equal(step("week_date", pa.int32()), 7), pc.equal(new.column("commits_this_week"), 0)]
        on = reduce(pc.and_, tests).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        first = np.flatnonzero(np.concatenate([[True], ~on]))
        weeks = np.diff(np.append(first, batch.num_rows))
        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(first)).columns, pa.array(weeks, pa.int64())], names=[*batch.schema.names, "weeks"])


def activity_runs(activity: DataFrame) -> DataFrame:
    """What the checks read of a weekly activity table, without loss: a row stands for `weeks` rows of a person, week by week,
    that have the same cumulative commits and flags, and no commits but in the first.

    Rows are joined as they lie in a partition; their order decides only how many rows are left, about as many as active
    weeks where a person's idle weeks lie behind the active one. So the dense table is neither shuffled nor sorted.
    """
    core = F.col("is_core_this_week") if "is_core_this_week" in activity.columns else F.lit(False)
    outside = F.coalesce(~F.col("contribution_percentage").between(0, 100), F.lit(False))
    number = lambda c, kind: F.col(c).cast(kind).alias(c)
    rows = activity.select(*PERSON, number("week_number", "int"), "week_date", number("commits_this_week", "bigint"), number("cumulative_commits", "bigint"), core.alias("is_core_this_week"), outside.alias("outside"))
    return rows.mapInArrow(_joined, RUNS)


def _apart(runs: DataFrame) -> DataFrame:
    """The runs, in single weeks for people whose runs lie over each other (a week stored twice), so that each person's rows
    follow by week."""
    order = Window.partitionBy(*PERSON).orderBy("week_number")
    reach = F.max(F.col("week_number") + F.col("weeks") - 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    over = F.coalesce(reach >= F.col("week_number"), F.lit(False))
    rows = runs.withColumn("_over", over).withColumn("_over", F.max("_over").over(Window.partitionBy(*PERSON)))
    i = F.col("_i")
    rows = rows.withColumn("_i", F.explode(F.when(F.col("_over"), F.sequence(F.lit(0), F.col("weeks").cast("int") - 1)).otherwise(F.array(F.lit(0)))))
    own = {"week_number": F.col("week_number") + i, "week_date": F.date_add("week_date", i * 7), "commits_this_week": F.when(i == 0, F.col("commits_this_week")).otherwise(F.lit(0)), "weeks": F.when(F.col("_over"), F.lit(1)).otherwise(F.col("weeks"))}
    return rows.withColumns(own).drop("_i", "_over")


def activity_checks(activity: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """check, violations of the weekly activity table: nulls, falling cumulative commits, cumulative unlike the running sum,
    weeks that aren't one apart, shares outside 0 to 100, negative counts; with `listed` also rows whose stored core flag
    differs from the timeline's core set.

    listed: project_name, author_email, week_date, weeks, the runs of weeks in which the timeline lists a person, no week
    twice (core.core_runs). A week stored twice stands in the order of its counts.
    """
    ids = ["project_name", "author_email"]
    # One shuffle serves the join by ids and the windows by person.
    rows = activity_runs(activity).repartition(*ids)
    if listed is not None:
        spans = listed.groupBy(*ids).agg(F.collect_list(F.struct("week_date", F.col("weeks").cast("bigint").alias("weeks"))).alias("_listed"))
        rows = rows.join(spans.hint("merge"), ids, "left")
    rows = _apart(rows)
    order = Window.partitionBy(*PERSON).orderBy("week_number", "cumulative_commits", "commits_this_week")
    run = F.sum("commits_this_week").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("run", run).withColumn("before", F.lag("cumulative_commits").over(order)).withColumn("week_before", F.lag(F.col("week_number") + F.col("weeks") - 1).over(order))
    # Tests of all rows of a run, and of its first row against the one before; the rows of a run follow each other.
    each = {
        "null_keys": F.col("project_name").isNull() | F.col("author_email").isNull() | F.col("week_date").isNull(),
        "cumulative_not_sum": F.col("cumulative_commits") != F.col("run"),
        "share_out_of_range": F.col("outside"),
    }
    first = {
        "cumulative_falls": F.col("cumulative_commits") < F.col("before"),
        "week_not_next": F.col("week_number") != F.col("week_before") + 1,
        "negative_commits": F.col("commits_this_week") < 0,
    }
    counts = {k: F.when(t, F.col("weeks")).otherwise(0) for k, t in each.items()} | {k: F.when(t, 1).otherwise(0) for k, t in first.items()}
    names = ["null_keys", "cumulative_falls", "cumulative_not_sum", "week_not_next", "share_out_of_range", "negative_commits"]
    if listed is not None:
        # Weeks of the run that a listed run holds too.
        days = lambda s: F.datediff(s["week_date"], F.col("week_date"))
        shift = lambda s: F.floor(days(s) / 7)
        both = lambda s: F.when(days(s) % 7 == 0, F.greatest(F.lit(0), F.least(F.col("weeks"), shift(s) + s["weeks"]) - F.greatest(F.lit(0), shift(s)))).otherwise(0)
        inside = F.coalesce(F.aggregate("_listed", F.lit(0).cast("bigint"), lambda a, s: a + F.coalesce(both(s), F.lit(0)).cast("bigint")), F.lit(0))
        counts["core_flag_unlike_timeline"] = F.when(F.col("is_core_this_week"), F.col("weeks") - inside).when(~F.col("is_core_this_week"), inside).otherwise(0)
        names.append("core_flag_unlike_timeline")
    wide = rows.agg(*[F.coalesce(F.sum(counts[k]), F.lit(0)).cast("bigint").alias(k) for k in names])
    return wide.unpivot([], names, "check", "violations")


def core_flag_check(activity: DataFrame, timeline: DataFrame) -> DataFrame:
    """check, violations: rows whose stored core flag differs from the core set of a stored timeline (project_name, week_date,
    core array). core.core_runs lists the same without a row for a person and week; activity_checks takes it as it is."""
    listed = timeline.select("project_name", F.explode("core").alias("author_email"), "week_date").distinct().withColumn("weeks", F.lit(1).cast("bigint"))
    return activity_checks(activity, listed).where("check = 'core_flag_unlike_timeline'")


def coverage_of(core: DataFrame, counts: DataFrame) -> DataFrame:
    """project_name, commits, core_commits, percent: the share of a project's commits by its core.

    core: project_name, author_email, a row a member; counts: project_name, author_email, n (core.contributor_counts)."""
    # Both grow with the people.
    both = counts.join(core.select("project_name", "author_email", F.lit(1).alias("in_core")).hint("merge"), ["project_name", "author_email"], "left")
    out = both.groupBy("project_name").agg(F.sum("n").alias("commits"), F.sum(F.when(F.col("in_core").isNotNull(), F.col("n")).otherwise(0)).alias("core_commits"))
    return out.withColumn("percent", F.col("core_commits") * 100.0 / F.col("commits"))


def core_coverage(timeline: DataFrame, commits: DataFrame) -> DataFrame:
    """coverage_of the core of the last week that a stored timeline lists (project_name, week_date, core array). core.last_core is
    that of the commits themselves, without a row for a person and week."""
    last = timeline.groupBy("project_name").agg(F.max_by("core", "week_date").alias("core"))
    return coverage_of(last.select("project_name", F.explode("core").alias("author_email")), contributor_counts(commits))


def transition_checks(transitions: DataFrame) -> DataFrame:
    """check, violations: censored unlike a missing core week, duplicate people, negative times, event time unlike weeks to core."""
    tests = {
        "censored_unlike_core": F.col("censored") != F.col("first_core_week").isNull(),
        "negative_time": F.col("time_to_event_weeks") < 0,
        "event_time_unlike_weeks": F.col("became_core") & (F.col("time_to_event_weeks") != F.col("weeks_to_core")),
    }
    people = transitions.groupBy(*PERSON).agg(F.count(F.lit(1)).alias("k"), *[count_if(F.coalesce(t, F.lit(False))).alias(k) for k, t in tests.items()])
    sums = [F.coalesce(F.sum(k), F.lit(0)).cast("bigint").alias(k) for k in tests]
    wide = people.agg(*sums, F.coalesce(count_if(F.col("k") > 1), F.lit(0)).alias("duplicate_people"))
    return wide.unpivot([], [*tests, "duplicate_people"], "check", "violations")
