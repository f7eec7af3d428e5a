"""Milestones of newcomers and the sequences they form.

timeline: keys, event_id, event_type, event_timestamp, pr_state (merged, rejected or closed, open; null if no pull request).
Events of equal time are ordered by event_id. Each function returns a row for each person who reaches the milestone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import count_if, wilson_lower_bound
from trailmark.operators.stats import chi_square_of_counts

KEYS = ("person",)
#: States of a sequence, by milestone column.
STATES = {
    "first_merged": "FirstMergedPullRequest",
    "sustained": "SustainedParticipation12w",
    "recovery": "FailureRecovery",
    "return": "ReturnAfterExtendedAbsence",
    "acceptance": "HighAcceptanceTrajectory",
    "direct": "DirectCommitAccessProxy",
}


def _pr() -> Column:
    return F.col("event_type") == "pull_request"


def _order(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("event_timestamp", "event_id")


def with_event_week(timeline: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The timeline with event_week. A timeline that has it keeps it (build_timeline counts from the first commit); else it is
    whole weeks since the person's first commit, or first event where there is no commit."""
    if "event_week" in timeline.columns:
        return timeline
    span = Window.partitionBy(*keys)
    first = F.coalesce(F.min(F.when(F.col("event_type") == "commit", F.col("event_timestamp"))).over(span), F.min("event_timestamp").over(span))
    return timeline.withColumn("event_week", F.floor(F.datediff("event_timestamp", first) / 7).cast("int"))


def first_merged_pr(timeline: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, first_merged_at, first_merged_week."""
    rows = with_event_week(timeline, keys).where(_pr() & (F.col("pr_state") == "merged"))
    return rows.groupBy(*keys).agg(F.min("event_timestamp").alias("first_merged_at"), F.min("event_week").alias("first_merged_week"))


def sustained_participation(timeline: DataFrame, keys: Sequence[str] = KEYS, width: int = 12, need: int = 9, reference_compat: bool = False) -> DataFrame:
    """keys, sustained_week: the last week of the first `width` weeks of which `need` are active.

    Windows start in the first active week or later and end in the last active week at the latest; with
    reference_compat the very last of them isn't looked at.
    """
    weeks = with_event_week(timeline, keys).where("event_week is not null").select(*keys, "event_week").distinct()
    span = Window.partitionBy(*keys)
    weeks = weeks.withColumn("first", F.min("event_week").over(span)).withColumn("last", F.max("event_week").over(span))
    # The count can only rise in an active week, so each active week can be the first of the window's last weeks.
    ahead = F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy("event_week").rangeBetween(-(width - 1), 0))
    found = weeks.withColumn("n", ahead).withColumn("end", F.greatest(F.col("event_week"), F.col("first") + width - 1))
    limit = F.col("last") - 1 if reference_compat else F.col("last")
    return found.where((F.col("n") >= need) & (F.col("end") <= limit)).groupBy(*keys).agg(F.min("end").alias("sustained_week"))


def component_breadth(timeline: DataFrame, keys: Sequence[str] = KEYS, component: str = "component", need: int = 5) -> DataFrame:
    """keys, breadth_week: the week in which pull requests first reach `need` components; breadth_supported: any is known."""
    rows = with_event_week(timeline, keys).where(_pr() & F.col(component).isNotNull())
    firsts = rows.groupBy(*keys, component).agg(F.min("event_week").alias("w"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("w", component))
    return firsts.withColumn("place", place).groupBy(*keys).agg(F.min(F.when(F.col("place") == need, F.col("w"))).alias("breadth_week"), F.lit(True).alias("breadth_supported"))


def failure_recovery(timeline: DataFrame, keys: Sequence[str] = KEYS, rejected: str = "closed") -> DataFrame:
    """keys, recovery_at: the first event after the first rejected pull request."""
    first = F.min(F.when(_pr() & (F.col("pr_state") == rejected), F.col("event_timestamp"))).over(Window.partitionBy(*keys))
    return timeline.withColumn("rejected_at", first).where("event_timestamp > rejected_at").groupBy(*keys).agg(F.min("event_timestamp").alias("recovery_at"))


def return_after_absence(timeline: DataFrame, keys: Sequence[str] = KEYS, least: int = 90, most: int = 180) -> DataFrame:
    """keys, return_at: the first event after a gap of `least` to `most` whole days."""
    before = F.lag("event_timestamp").over(_order(keys))
    days = F.floor((F.unix_seconds("event_timestamp") - F.unix_seconds("before")) / 86400)
    return timeline.withColumn("before", before).withColumn("gap", days).where(F.col("gap").between(least, most)).groupBy(*keys).agg(F.min("event_timestamp").alias("return_at"))


def acceptance_trajectory(timeline: DataFrame, keys: Sequence[str] = KEYS, first: int = 10) -> DataFrame:
    """keys, acceptance_at, acceptance_variant. classic: the merged share reaches 0.67 among the first ten pull requests;
    adjusted: its Wilson lower bound does, from the third on; simple: the whole share does, with three at least, dated to
    the tenth (or last). The first that holds counts."""
    order = _order(keys)
    merged = F.when(F.col("pr_state") == "merged", 1).otherwise(0)
    rows = timeline.where(_pr()).withColumn("i", F.row_number().over(order)).withColumn("k", F.sum(merged).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda test: F.min(F.when(test, F.struct("i", "event_timestamp")))["event_timestamp"]
    # Shares are compared in hundredths, as whole numbers.
    found = rows.groupBy(*keys).agg(
        at((F.col("i") <= first) & (F.col("k") * 100 >= F.col("i") * 67)).alias("classic"),
        at((F.col("i") >= 3) & (wilson_lower_bound(F.col("k"), F.col("i")) >= 0.67)).alias("adjusted"),
        F.max("i").alias("n"),
        F.max("k").alias("merged"),
        F.max(F.when(F.col("i") <= first, F.struct("i", "event_timestamp")))["event_timestamp"].alias("tenth"),
    )
    simple = F.when((F.col("n") >= 3) & (F.col("merged") * 100 >= F.col("n") * 67), F.col("tenth"))
    variant = F.when(F.col("classic").isNotNull(), "classic").when(F.col("adjusted").isNotNull(), "adjusted").when(simple.isNotNull(), "simple")
    out = found.select(*keys, F.coalesce("classic", "adjusted", simple).alias("acceptance_at"), variant.alias("acceptance_variant"))
    return out.where("acceptance_at is not null")


def direct_commit_access(timeline: DataFrame, keys: Sequence[str] = KEYS, need: int = 5) -> DataFrame:
    """keys, direct_at: the first of at least `need` commits after the last pull request."""
    order = _order(keys)
    rows = timeline.withColumn("i", F.row_number().over(order))
    rows = rows.withColumn("last_pr", F.max(F.when(_pr(), F.col("i"))).over(Window.partitionBy(*keys)))
    after = rows.where((F.col("i") > F.col("last_pr")) & (F.col("event_type") == "commit"))
    return after.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("event_timestamp").alias("direct_at")).where(F.col("n") >= need).drop("n")


def all_milestones(timeline: DataFrame, keys: Sequence[str] = KEYS, component: str | None = None) -> DataFrame:
    """A row for each person: start_at, start_week, events and every milestone's columns, null where it isn't reached."""
    timeline = with_event_week(timeline, keys)
    out = timeline.groupBy(*keys).agg(F.min("event_timestamp").alias("start_at"), F.min("event_week").alias("start_week"), F.count(F.lit(1)).alias("events"))
    parts = [f(timeline, keys) for f in (first_merged_pr, sustained_participation, failure_recovery, return_after_absence, acceptance_trajectory, direct_commit_access)]
    if component:
        parts.append(component_breadth(timeline, keys, component))
    for part in parts:
        out = out.join(part, list(keys), "left")
    return out


def milestone_counts(milestones: DataFrame) -> DataFrame:
    """One row: people and how many reach each milestone and acceptance variant."""
    known = [c for c in ("first_merged_at", "sustained_week", "breadth_week", "recovery_at", "return_at", "acceptance_at", "direct_at") if c in milestones.columns]
    variants = [count_if(F.col("acceptance_variant") == v).alias(f"acceptance_{v}") for v in ("classic", "adjusted", "simple")]
    return milestones.agg(F.count(F.lit(1)).alias("people"), *[F.count(c).alias(c.rsplit("_", 1)[0]) for c in known], *variants)


def milestone_sequences(milestones: DataFrame, keys: Sequence[str] = KEYS, min_events: int = 0) -> DataFrame:
    """keys, sequence: START, the reached states by time (ties by name) and END; repeats in a row count once.

    Sustained participation is dated from the start by the weeks since the start's; only classic acceptance counts. min_events keeps a cohort.
    """
    weeks = F.col("start_at") + F.make_interval(weeks=F.col("sustained_week") - F.coalesce(F.col("start_week"), F.lit(0)))
    dated = {"first_merged": F.col("first_merged_at"), "sustained": weeks, "recovery": F.col("recovery_at"), "return": F.col("return_at"), "acceptance": F.when(F.col("acceptance_variant") == "classic", F.col("acceptance_at")), "direct": F.col("direct_at")}
    events = F.array(*[F.struct(c.alias("at"), F.lit(STATES[k]).alias("name")) for k, c in dated.items()])
    names = F.transform(F.sort_array(F.filter(events, lambda e: e["at"].isNotNull())), lambda e: e["name"])
    whole = F.concat(F.array(F.lit("START")), names, F.array(F.lit("END")))
    once = F.filter(whole, lambda s, i: (i == 0) | (s != F.element_at(whole, F.greatest(i, F.lit(1)))))
    return milestones.where(F.col("events") >= min_events).select(*keys, once.alias("sequence"))


def milestone_rates(milestones: DataFrame, reached: dict[str, str], group: str = "project_type", week: dict[str, str] | None = None) -> DataFrame:
    """milestone, group, people, achieved, share and, for milestones with a week column, the median week (counted from 1) with
    and without values outside the quartile fences, and chi2 and p_value of the groups reaching it alike. reached: milestone -> boolean or nullable column."""
    week = week or {}
    tests = F.array(*[F.struct(F.lit(m).alias("milestone"), (F.col(c).isNotNull() & (F.col(c).cast("string") != "false")).alias("hit"), (F.col(week[m]).cast("double") + 1 if m in week else F.lit(None).cast("double")).alias("week")) for m, c in reached.items()])
    rows = milestones.select(group, F.explode(tests).alias("t")).select(group, "t.*")
    w = F.when(F.col("hit"), F.col("week"))
    out = rows.groupBy("milestone", group).agg(F.count(F.lit(1)).alias("people"), count_if(F.col("hit")).alias("achieved"), F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("share"), F.percentile(w, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    spread = F.col("q")[2] - F.col("q")[0]
    kept = rows.where("hit").join(out, ["milestone", group]).where((F.col("week") >= F.col("q")[0] - 1.5 * spread) & (F.col("week") <= F.col("q")[2] + 1.5 * spread))
    clean = kept.groupBy("milestone", group).agg(F.percentile("week", F.lit(0.5)).alias("median_week_clean"))
    test = chi_square_of_counts(out.select("milestone", "achieved", (F.col("people") - F.col("achieved")).alias("missed")), "achieved", "missed", ["milestone"]).select("milestone", "chi2", "p_value")
    return out.withColumn("median_week", F.col("q")[1]).drop("q").join(clean, ["milestone", group], "left").join(test, "milestone", "left")


def precore_activity_sweep(timeline: DataFrame, keys: Sequence[str] = KEYS, thresholds: Sequence[int] = (0, 1, 5, 10, 15, 20, 25, 50)) -> DataFrame:
    """threshold, kept (people with at least so many events), dropped."""
    each = timeline.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    kept = F.col("n") >= F.col("threshold")
    return each.groupBy("threshold").agg(count_if(kept).alias("kept"), count_if(~kept).alias("dropped"))


#: Key words of areas in commit messages and in titles of pull requests, tried in this order, and of helpful comments.
COMMIT_AREAS = (("documentation", ("doc", "readme", "tutorial")), ("testing", ("test", "spec", "coverage")), ("bugfix", ("fix", "bug", "patch")))
TITLE_AREAS = (("documentation", ("doc",)), ("testing", ("test",)), ("bugfix", ("fix", "bug")))
HELPFUL = ("try", "should", "could", "suggest", "recommend", "here's how", "example", "solution", "fix")


def _holds(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def contribution_area(text: str = "text") -> Column:
    """The area of a commit by its message, of a pull request by its title: the first whose key words lie anywhere in the text,
    else feature; null for other events."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))

    def area(kinds) -> Column:
        out = F.lit("feature")
        for name, words in reversed(kinds):
            out = F.when(_holds(low, words), name).otherwise(out)
        return out

    return F.when(F.col("event_type") == "commit", area(COMMIT_AREAS)).when(_pr(), area(TITLE_AREAS))


def milestones_v1(timeline: DataFrame, reviews: DataFrame, comments: DataFrame, keys: Sequence[str] = KEYS, text: str = "text", burst: int = 5, days: int = 90, gap: int = 30) -> DataFrame:
    """keys and, for each of seven milestones, its time and week (<name>_at, <name>_week; null where not reached):

    accepted: first merged pull request; sustained: the fifth of five contributions (merged requests and commits) in a row within
    90 days; returned: first event over 30 whole days after the one before; reviewed: first pull request of another that the
    person reviewed; crossed: first event in another area than the first (see contribution_area); helped: first thread of
    another with a comment by the person that holds a helpful word; recovered: first merged request after the first closed one.

    timeline: with `text`, the message or title. reviews, comments (with body): keys, event_id and owner of the person's
    reviews of pull requests and comments on threads in the timeline; those without an owner don't count.
    """
    order = _order(keys)
    rows = with_event_week(timeline, keys).withColumn("e", F.struct("event_timestamp", "event_id", "event_week"))
    merged, closed = _pr() & (F.col("pr_state") == "merged"), _pr() & F.col("pr_state").isin("closed", "rejected")
    first_of = lambda test: F.min(F.when(test, F.col("e")))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    area = rows.withColumn("area", contribution_area(text)).withColumn("first_area", F.first("area", ignorenulls=True).over(whole))
    before = F.lag("event_timestamp").over(order)
    away = F.floor((F.unix_seconds("event_timestamp") - F.unix_seconds(before)) / 86400)
    area = area.withColumn("away", away).withColumn("closed", F.min(F.when(closed, F.col("e"))).over(whole))
    own = area.groupBy(*keys).agg(
        first_of(merged).alias("accepted"),
        first_of(F.col("away") > gap).alias("returned"),
        first_of(F.col("area") != F.col("first_area")).alias("crossed"),
        first_of(merged & F.col("closed").isNotNull() & (F.struct("event_timestamp", "event_id") > F.struct("closed.event_timestamp", "closed.event_id"))).alias("recovered"),
    )
    run = rows.where(merged | (F.col("event_type") == "commit")).withColumn("fifth", F.lead("e", burst - 1).over(order))
    run = run.where(F.datediff("fifth.event_timestamp", "event_timestamp") <= days).groupBy(*keys).agg(F.min("fifth").alias("sustained"))
    by_id = lambda frame: rows.join(frame.where(F.col("owner").isNotNull() & (F.col("owner") != "") & (F.col("owner") != F.col(keys[0]))), [*keys, "event_id"])
    seen = by_id(reviews.select(*keys, "event_id", "owner")).where(_pr()).groupBy(*keys).agg(F.min("e").alias("reviewed"))
    words = _holds(F.lower(F.coalesce(F.col("body"), F.lit(""))), HELPFUL)
    said = by_id(comments.select(*keys, "event_id", "owner", "body")).where(F.col("event_type").isin("pull_request", "issue") & words).groupBy(*keys).agg(F.min("e").alias("helped"))
    out = own
    for part in (run, seen, said):
        out = out.join(part, list(keys), "left")
    names = ("accepted", "sustained", "returned", "reviewed", "crossed", "helped", "recovered")
    return out.select(*keys, *[c for n in names for c in (F.col(f"{n}.event_timestamp").alias(f"{n}_at"), F.col(f"{n}.event_week").alias(f"{n}_week"))])
