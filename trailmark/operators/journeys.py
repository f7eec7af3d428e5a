"""Journeys from the first commit to core membership, from the weekly activity table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import correlation, count_if, week_start, weeks_between
from trailmark.operators.activity import PERSON, PROJECT
from trailmark.operators.stats import on_keys
from trailmark.operators.steps import core_cuts, count_levels, with_core_steps
from trailmark.operators.written import spread, written

#: Join no later than the first of these project weeks and reach the core within the second number of weeks: early core.
EARLY_JOIN_WEEKS, EARLY_CORE_WEEKS = 8, 4
#: Classes that each mode leaves out.
MODES = {"full": ("instant_core", "early_project_core", "low_activity"), "no_instant": ("instant_core", "low_activity"), "all": ()}


def transition_summary_basic(activity: DataFrame, active_days: int = 90) -> DataFrame:
    """A person's first and last active week, totals, first core week, whether still core, greatest share, and status at the
    end: core, active (a commit in the last `active_days`) or inactive."""
    active = F.col("commits_this_week") > 0
    out = activity.groupBy(*PERSON).agg(
        F.min("week_date").alias("first_week"),
        F.max(F.when(active, F.col("week_date"))).alias("last_active_week"),
        F.sum("commits_this_week").alias("total_commits"),
        F.min(F.when(F.col("is_core_this_week"), F.col("week_date"))).alias("first_core_week"),
        F.max_by("is_core_this_week", "week_date").alias("core_at_end"),
        F.max("contribution_percentage").alias("max_percentage"),
        F.max("week_date").alias("own_end"),
    )
    # A project's end is that of its people: a row a person meets a row a project, not a window over all weeks of a project.
    out = written(out)
    out = on_keys(out, out.groupBy(*PROJECT).agg(F.max("own_end").alias("project_end")), PROJECT).drop("own_end")
    recent = F.datediff("project_end", "last_active_week") < active_days
    status = F.when(F.col("core_at_end"), "core").when(recent, "active").otherwise("inactive")
    return out.withColumn("final_status", status).drop("project_end")


def contributor_transitions(activity: DataFrame, mode: str = "all", min_commits: int = 1) -> DataFrame:
    """One row a journey. Pre-core figures cover the weeks up to the first core week, or all weeks of a person who never
    becomes core (censored). One window by person finds the first core week and numbers the weeks; one aggregate on the
    same partitioning does the rest.
    """
    person = Window.partitionBy(*PERSON)
    core = F.col("is_core_this_week")
    rows = activity.withColumn("core_week", F.min(F.when(core, F.col("week_number"))).over(person)).withColumn("i", F.col("week_number") - F.min("week_number").over(person))
    rows = rows.withColumn("to_core", F.max(F.when(F.col("week_number") == F.col("core_week"), F.col("i"))).over(person))
    before = F.col("core_week").isNull() | (F.col("week_number") <= F.col("core_week"))
    active = F.col("commits_this_week") > 0
    at_core = lambda c: F.max(F.when(F.col("week_number") == F.col("core_week"), F.col(c)))
    pre = F.when(before & active, F.col("commits_this_week"))
    # A quarter of the pre-core weeks, rounded down, one at least.
    quarter = F.greatest(F.lit(1), F.floor((F.col("to_core") + 1) / 4))
    early = F.sum(F.when(F.col("i") < quarter, F.col("commits_this_week")).otherwise(0))
    late = F.sum(F.when((F.col("i") > F.col("to_core") - quarter) & (F.col("i") <= F.col("to_core")), F.col("commits_this_week")).otherwise(0))
    t = rows.groupBy(*PERSON).agg(
        F.min("week_date").alias("first_commit_date"),
        F.min("week_number").alias("first_commit_week"),
        F.max("week_date").alias("last_observed_date"),
        F.max("week_number").alias("last_observed_week"),
        F.max("cumulative_commits").alias("total_commits"),
        F.max("cumulative_lines_changed").alias("total_lines_changed"),
        count_if(active).alias("total_active_weeks"),
        F.max("core_week").alias("first_core_week"),
        F.min(F.when(core, F.col("week_date"))).alias("first_core_date"),
        F.max("to_core").alias("weeks_to_core"),
        at_core("cumulative_commits").alias("commits_to_core"),
        at_core("cumulative_lines_changed").alias("lines_changed_to_core"),
        at_core("rank_this_week").alias("rank_at_first_core"),
        at_core("contribution_percentage").alias("contribution_percentage_at_first_core"),
        F.count(pre).alias("active_before"),
        F.coalesce(F.avg(pre), F.lit(0.0)).alias("avg_commits_per_active_week_before_core"),
        F.coalesce(F.max(pre), F.lit(0)).alias("max_commits_week_before_core"),
        F.coalesce(F.stddev_samp(pre), F.lit(0.0)).alias("std_commits_before_core"),
        F.when(F.max("to_core") >= 8, late / (early + 1) - 1).otherwise(F.lit(0.0)).alias("growth_rate_before_core"),
        count_if(core).alias("core_weeks"),
        F.max_by(core, "week_number").alias("core_in_last"),
        F.count(F.lit(1)).alias("weeks"),
    )
    return _with_derived(t, mode, min_commits)


def contributor_journeys(commits: DataFrame, percent: int = 80, mode: str = "all", min_commits: int = 1) -> DataFrame:
    """The rows of contributor_transitions straight from commits, without the dense grid: a row for each active week, the
    core's steps from change points (see steps), the rank at the first core week from the counts' levels."""
    lines = F.col("total_insertions") + F.col("total_deletions")
    weekly = written(commits.groupBy(*PERSON, week_start(F.col("commit_date")).alias("week_date")).agg(F.count(F.lit(1)).alias("c"), F.sum(lines).alias("lines")))
    span = weekly.groupBy(*PROJECT).agg(F.min("week_date").alias("start"), F.max("week_date").alias("stop"))
    order, person = Window.partitionBy(*PERSON).orderBy("week_date"), Window.partitionBy(*PERSON)
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    week = lambda c: weeks_between(F.col(c), F.col("start")) + 1
    held = spread(weekly.join(span, list(PROJECT)), *PERSON).withColumn("at", week("week_date")).withColumn("last", week("stop"))
    held = held.withColumn("n", F.sum("c").over(run)).withColumn("lines", F.sum("lines").over(run)).withColumn("until", F.coalesce(F.lead("at").over(order), F.col("last") + 1))
    held = written(held)
    levels = written(count_levels(held, PROJECT))
    cuts = written(core_cuts(levels, PROJECT, percent))
    steps = F.col("core_steps")
    rows = with_core_steps(held, cuts, PROJECT).withColumn("core_first", F.get(steps, F.lit(0))).withColumn("core_weeks", F.size(steps)).withColumn("core_in_last", F.array_contains(steps, F.col("last")))
    rows = rows.drop("core_steps").repartition(*PERSON)  # apart from the join by project, so that a large one can be split
    rows = rows.withColumn("core_week", F.min("core_first").over(person)).withColumn("joined", F.min("at").over(person))
    i, to_core = F.col("at") - F.col("joined"), F.col("core_week") - F.col("joined")
    pre = F.when(F.col("core_week").isNull() | (F.col("at") <= F.col("core_week")), F.col("c"))
    at_core = lambda c: F.max(F.when((F.col("at") <= F.col("core_week")) & (F.col("core_week") < F.col("until")), F.col(c)))
    quarter = F.greatest(F.lit(1), F.floor((to_core + 1) / 4))
    early = F.sum(F.when(i < quarter, F.col("c")).otherwise(0))
    late = F.sum(F.when((i > to_core - quarter) & (i <= to_core), F.col("c")).otherwise(0))
    t = rows.groupBy(*PERSON).agg(
        F.min("week_date").alias("first_commit_date"),
        F.min("at").alias("first_commit_week"),
        F.max("stop").alias("last_observed_date"),
        F.max("last").alias("last_observed_week"),
        F.max("n").alias("total_commits"),
        F.max("lines").alias("total_lines_changed"),
        F.count(F.lit(1)).alias("total_active_weeks"),
        F.max("core_week").alias("first_core_week"),
        F.max(F.date_add("start", (F.col("core_week") - 1) * 7)).alias("first_core_date"),
        F.max(to_core).alias("weeks_to_core"),
        at_core("n").alias("commits_to_core"),
        at_core("lines").alias("lines_changed_to_core"),
        F.count(pre).alias("active_before"),
        F.coalesce(F.avg(pre), F.lit(0.0)).alias("avg_commits_per_active_week_before_core"),
        F.coalesce(F.max(pre), F.lit(0)).alias("max_commits_week_before_core"),
        F.coalesce(F.stddev_samp(pre), F.lit(0.0)).alias("std_commits_before_core"),
        F.when(F.max(to_core) >= 8, late / (early + 1) - 1).otherwise(F.lit(0.0)).alias("growth_rate_before_core"),
        F.sum("core_weeks").alias("core_weeks"),
        F.max("core_in_last").alias("core_in_last"),
        (F.max("last") - F.min("at") + 1).alias("weeks"),
    )
    percentage = F.round(F.col("n") * 100.0 / F.col("total"), 4).alias("contribution_percentage_at_first_core")
    places = levels.select(*PROJECT, F.col("at").alias("first_core_week"), F.col("n").alias("commits_to_core"), (F.col("higher") + 1).cast("int").alias("rank_at_first_core"), percentage)
    return _with_derived(t.join(places, [*PROJECT, "first_core_week", "commits_to_core"], "left"), mode, min_commits)


def _with_derived(t: DataFrame, mode: str, min_commits: int) -> DataFrame:
    became = F.col("first_core_week").isNotNull()
    observed = F.col("last_observed_week") - F.col("first_commit_week") + 1
    after = F.col("last_observed_week") - F.col("first_core_week")
    mean = F.col("avg_commits_per_active_week_before_core")
    t = t.withColumn("became_core", became).withColumn("censored", ~became).withColumn("total_weeks_observed", observed)
    t = t.withColumn("activity_rate", F.col("total_active_weeks") / observed)
    t = t.withColumn("active_weeks_to_core", F.when(became, F.col("active_before")))
    t = t.withColumn("burst_ratio_before_core", F.when(became & (mean > 0), F.col("max_commits_week_before_core") / mean).otherwise(F.lit(0.0)))
    t = t.withColumn("commit_consistency_before_core", F.col("active_before") / F.when(became, F.col("weeks_to_core") + 1).otherwise(observed))
    t = t.withColumn("time_to_event_weeks", F.coalesce("weeks_to_core", observed))
    t = t.withColumn("is_early_joiner", F.col("first_commit_week") <= EARLY_JOIN_WEEKS).withColumn("is_fast_core", became & (F.col("weeks_to_core") <= EARLY_CORE_WEEKS))
    t = t.withColumn("weeks_observed_after_core", F.coalesce(after, F.lit(0))).withColumn("still_core_at_end", (after > 0) & F.col("core_in_last"))
    t = t.withColumn("still_core_at_end", F.coalesce("still_core_at_end", F.lit(False)))
    t = t.withColumn("total_weeks_as_core", F.when(became, F.when(after > 0, F.col("core_weeks")).otherwise(1)).otherwise(0))
    t = t.withColumn("core_retention_rate", F.col("total_weeks_as_core") / F.col("weeks"))
    t = with_exclusion_class(t, min_commits).drop("active_before", "core_weeks", "core_in_last", "weeks")
    left_out = MODES[mode]
    return t.where(~F.col("contributor_classification").isin(*left_out)) if left_out else t


def with_exclusion_class(transitions: DataFrame, min_commits: int = 1, early_join: int = EARLY_JOIN_WEEKS, early_core: int = EARLY_CORE_WEEKS) -> DataFrame:
    """Adds contributor_classification: low_activity, instant_core, early_project_core or include, the first that holds."""
    early = (F.col("first_commit_week") <= early_join) & (F.col("weeks_to_core") <= early_core)
    kind = F.when(F.col("total_commits") < min_commits, "low_activity").when(~F.col("became_core"), "include").when(F.col("weeks_to_core") == 0, "instant_core").when(early, "early_project_core").otherwise("include")
    return transitions.withColumn("contributor_classification", kind)


def early_core_threshold_sweep(transitions: DataFrame, thresholds: Sequence[int] = (-1, 0, 1, 2, 4, 8, 12, 26, 52), group: str = "project_type") -> DataFrame:
    """For each threshold (-1: none) and group: rows left after dropping cores of at most so many weeks, cores, core_rate,
    and mean, median, std, min, max, q25, q75 of the weeks to core. The rows are copied once a threshold, in the map."""
    t = transitions.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    kept = t.where(~F.col("became_core") | (F.col("threshold") < 0) | (F.col("weeks_to_core") > F.col("threshold")))
    w = F.col("weeks_to_core").cast("double")
    q = F.percentile(w, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = kept.groupBy("threshold", group).agg(F.count(F.lit(1)).alias("n"), count_if(F.col("became_core")).alias("cores"), F.avg(w).alias("mean"), F.stddev_samp(w).alias("std"), F.min(w).alias("min"), F.max(w).alias("max"), q.alias("q"))
    return out.select("threshold", group, "n", "cores", (F.col("cores") / F.col("n")).alias("core_rate"), "mean", F.col("q")[1].alias("median"), "std", "min", "max", F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"))


def early_joiner_shares(transitions: DataFrame, thresholds: Sequence[int] = (1, 4, 8, 12, 26, 52)) -> DataFrame:
    """threshold, cores (joined by then), share of all cores, instant, by_week_1, median_weeks."""
    cores = transitions.where("became_core")
    total = cores.agg(F.count(F.lit(1)).alias("all_cores"))
    t = cores.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds]))).where("first_commit_week <= threshold")
    out = t.groupBy("threshold").agg(F.count(F.lit(1)).alias("cores"), count_if(F.col("weeks_to_core") == 0).alias("instant"), count_if(F.col("weeks_to_core") <= 1).alias("by_week_1"), F.percentile("weeks_to_core", F.lit(0.5)).alias("median_weeks"))
    return out.crossJoin(total).select("threshold", "cores", (F.col("cores") / F.col("all_cores")).alias("share"), "instant", "by_week_1", "median_weeks")  # one row


def early_joiner_strategies(transitions: DataFrame) -> DataFrame:
    """strategy, excluded, remaining, core_rate, median_weeks, median_commits for four ways to leave out early cores."""
    w, first = F.col("weeks_to_core"), F.col("first_commit_week") <= EARLY_JOIN_WEEKS
    masks = {"instant": w == 0, "by_week_1": w <= 1, "early_joiner_core": first & F.col("became_core"), "early_and_fast": first & (w <= EARLY_CORE_WEEKS)}
    tests = F.array(*[F.struct(F.lit(k).alias("strategy"), F.coalesce(m, F.lit(False)).alias("out")) for k, m in masks.items()])
    t = transitions.withColumn("s", F.explode(tests)).select("*", "s.strategy", "s.out")
    left = lambda c: F.when(~F.col("out") & F.col("became_core"), F.col(c))
    return t.groupBy("strategy").agg(
        count_if(F.col("out")).alias("excluded"),
        count_if(~F.col("out")).alias("remaining"),
        (count_if(~F.col("out") & F.col("became_core")) / count_if(~F.col("out"))).alias("core_rate"),
        F.percentile(left("weeks_to_core"), F.lit(0.5)).alias("median_weeks"),
        F.percentile(left("commits_to_core"), F.lit(0.5)).alias("median_commits"),
    )


def commits_to_core_distribution(transitions: DataFrame, group: str = "project_type") -> DataFrame:
    """group, commits_to_core, n and the group's share with at most that many."""
    each = transitions.where("became_core").groupBy(group, "commits_to_core").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(group).orderBy("commits_to_core").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("share_up_to", F.sum("n").over(run) / F.sum("n").over(Window.partitionBy(group)))


def commits_to_core_shares(transitions: DataFrame, bounds: Sequence[int] = (1, 2, 5, 10, 20, 50), group: str = "project_type") -> DataFrame:
    """group, bound, share of cores with at most that many commits, and median weeks among them (a min-commit sweep turned round)."""
    t = transitions.where("became_core").withColumn("bound", F.explode(F.array(*[F.lit(b) for b in bounds])))
    inside = F.col("commits_to_core") <= F.col("bound")
    return t.groupBy(group, "bound").agg(F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("share"), F.percentile(F.when(inside, F.col("weeks_to_core")), F.lit(0.5)).alias("median_weeks"))


def commits_to_core_by_year(transitions: DataFrame) -> DataFrame:
    """year of the first core week, n, median commits and weeks to core."""
    return transitions.where("became_core").groupBy(F.year("first_core_date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.percentile("commits_to_core", F.lit(0.5)).alias("median_commits"), F.percentile("weeks_to_core", F.lit(0.5)).alias("median_weeks"))


def commits_to_core_by_size(transitions: DataFrame, small: int = 20, large: int = 100) -> DataFrame:
    """Projects in buckets by people (small, medium, large): projects, cores, median commits to core, and projects whose
    cores all needed at most 2 commits."""
    by_project = transitions.groupBy("project_name").agg(F.count(F.lit(1)).alias("people"), count_if(F.col("became_core")).alias("cores"), F.max(F.when(F.col("became_core"), F.col("commits_to_core"))).alias("most"))
    size = F.when(F.col("people") <= small, "small").when(F.col("people") <= large, "medium").otherwise("large")
    both = transitions.join(by_project.withColumn("size", size), "project_name")
    med = both.where("became_core").groupBy("size").agg(F.percentile("commits_to_core", F.lit(0.5)).alias("median_commits"))
    counts = by_project.withColumn("size", size).groupBy("size").agg(F.count(F.lit(1)).alias("projects"), F.sum("cores").alias("cores"), count_if(F.col("most") <= 2).alias("all_need_2_at_most"))
    return counts.join(med, "size", "left")


def time_commit_correlation(transitions: DataFrame, group: str = "project_type", fast_weeks: int = 4, few_commits: int = 5) -> DataFrame:
    """group, n, Pearson r of weeks and commits to core, and how many are fast, need few commits, or both."""
    w, c = F.col("weeks_to_core"), F.col("commits_to_core")
    return transitions.where("became_core").groupBy(group).agg(F.count(F.lit(1)).alias("n"), correlation(w, c).alias("r"), count_if(w <= fast_weeks).alias("fast"), count_if(c <= few_commits).alias("few"), count_if((w <= fast_weeks) & (c <= few_commits)).alias("fast_and_few"))
