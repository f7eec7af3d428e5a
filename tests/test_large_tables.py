"""Steps whose plans must not hold a growing table on the driver or shuffle the dense grid, and their results the long way."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import activity, core, features, journeys, kmeans, series, threads, treatment
from trailmark.plans import q_treatment, views
from trailmark.plans.catalog import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def commits(spark):
    rnd, start, out = random.Random(7), datetime.datetime(2020, 1, 6), []
    for k in range(300):
        project, person = rnd.choice("pq"), f"{rnd.choice('abcdef')}{int(rnd.expovariate(0.7))}"
        out.append((project, "A" if project == "p" else "B", person, str(k), start + datetime.timedelta(days=rnd.randrange(150)), rnd.randrange(9), rnd.randrange(9), 1))
    return spark.createDataFrame(out, "project_name string, project_type string, author_email string, commit_hash string, commit_date timestamp, total_insertions long, total_deletions long, files_modified_count long")


def plain(frame, *columns):
    return sorted(map(str, frame.select(*columns).collect()))


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def views_query(name, spark):
    return QUERIES[name](spark, DIR)


def test_activity_equals_windows_over_the_grid_and_the_grid_is_not_shuffled(commits):
    new = activity.contributor_activity(commits)
    old = activity.with_core_flag(activity.with_rank(activity.with_cumulative(activity.weekly_grid(activity.weekly_contributor_agg(commits)))))
    assert sorted(new.dtypes) == sorted(old.dtypes)
    assert plain(new, *sorted(new.columns)) == plain(old, *sorted(new.columns))
    text = plan(new)
    above = text[: text.index("Generate explode(")]
    assert "Exchange" not in above and "Window" not in above
    grid = plan(activity.weekly_grid(activity.weekly_contributor_agg(commits)))
    assert "Exchange" not in grid[: grid.index("Generate explode(")] and "Join" not in grid[: grid.index("Generate explode(")]


def test_orders_customers_and_lines_are_not_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        text = plan(views.commits(spark, DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("BroadcastExchange") == 1 and "nation.parquet" in text[text.index("BroadcastExchange") :]


def test_gaps_come_from_one_pass(commits):
    found = features.active_gap_stats(activity.weekly_grid(activity.weekly_contributor_agg(commits)))
    top = plan(found)
    assert "Join" not in top[: top.index("Generate explode(")]
    want = {}
    for r in activity.weekly_contributor_agg(commits).collect():
        want.setdefault((r.project_name, r.author_email), []).append(r.week_date)
    for r in found.collect():
        weeks = sorted(want[r.project_name, r.author_email])
        gaps = [(b - a).days // 7 for a, b in zip(weeks, weeks[1:])]
        assert (r.max_gap, round(r.avg_gap, 9), round(r.std_gap, 9)) == (max(gaps, default=0), round(float(np.mean(gaps)) if gaps else 0.0, 9), round(float(np.std(gaps)) if gaps else 0.0, 9))


def test_first_core_weeks_are_those_of_the_timeline(commits):
    listed = core.core_timeline_weekly(commits).select("project_name", "week_date", F.explode("core").alias("author_email")).groupBy("project_name", "author_email").agg(F.min("week_date").alias("week_date"))
    names = ["project_name", "author_email", "week_date"]
    assert plain(core.first_core_weeks(commits), *names) == plain(listed, *names)


def test_series_equal_those_of_the_weekly_rows_without_a_row_a_week(spark):
    rnd, start, rows = random.Random(3), datetime.datetime(2021, 3, 3), []
    for i in range(400):
        rows.append((None if i % 50 == 0 else f"u{rnd.randrange(30)}", rnd.randrange(60), rnd.choice(["commit", "issue", "pull_request"]), rnd.choice(["merged", "open", None]), start + datetime.timedelta(days=rnd.randrange(400))))
    events = spark.createDataFrame(rows, "person string, event_week int, event_type string, pr_state string, event_timestamp timestamp")
    comments = spark.createDataFrame([(f"u{rnd.randrange(30)}", rnd.randrange(80), 2) for _ in range(60)] + [("nobody", 3, 1)], "person string, event_week int, comments int")
    for said in (None, comments):
        new = series.contribution_series(events, comments=said)
        old = series.as_series(series.with_index(series.with_duration(series.weekly_contribution_metrics(events, comments=said))))
        rounded = F.transform("series", lambda x: F.round(x, 9) + 0.0).alias("series")
        assert plain(new, "person", rounded) == plain(old, "person", rounded)
        assert "Generate" not in plan(new)


def test_nearest_centres_equal_those_by_differences():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(0, 3, (9000, 4)).astype(float), rng.normal(size=(500, 4)) * 1e-7 + 1e3])
    sets = [rng.integers(0, 3, (k, 4)).astype(float) for k in (1, 2, 5)] + [np.array([x[-1], x[-2], x[-1]])]
    for (at, square), centres in zip(kmeans.nearest_of(x, sets), sets, strict=True):
        whole = np.stack([((x - c) ** 2).sum(1) for c in centres], 1)
        assert (at == whole.argmin(1)).all() and (square == whole[np.arange(len(x)), at]).all()


def test_core_weeks_are_those_of_the_flag_without_a_row_a_week(commits):
    flagged = activity.contributor_activity(commits).where("is_core_this_week").groupBy("project_name", "author_email").agg(F.count(F.lit(1)).alias("core_weeks"))
    found = core.core_weeks(commits)
    assert found.dtypes == flagged.dtypes
    assert plain(found, *found.columns) == plain(flagged, *found.columns)
    text = plan(views_query("is_core_flag", commits.sparkSession))
    assert "Generate explode(" not in text[: text.index("cuts")]


def test_the_cohort_is_that_of_the_grid_and_reads_no_grid(commits):
    grid, told = activity.weekly_grid(activity.weekly_contributor_agg(commits)), journeys.contributor_journeys(commits)
    for least in (1, 8, 12):
        rows = features.pre_core(grid, told, 2, least).groupBy(*activity.PERSON).agg(F.max("label_became_core").alias("label_became_core"))
        found = features.pre_core_people(told, 2, least)
        assert plain(found, *found.columns) == plain(rows, *found.columns)
    assert "Generate explode(sequence" not in plan(views_query("pre_core_cohort", commits.sparkSession))


def test_weeks_of_a_person_are_filled_in_many_tasks_without_a_shuffle_or_join(spark):
    rnd, start, rows = random.Random(11), datetime.datetime(2021, 3, 3), []
    for i in range(300):
        rows.append((None if i % 50 == 0 else f"u{rnd.randrange(20)}", rnd.choice([None, *range(50)]), rnd.choice(["commit", "issue", "pull_request"]), rnd.choice(["merged", "open", None]), start + datetime.timedelta(days=rnd.randrange(400))))
    events = spark.createDataFrame(rows, "person string, event_week int, event_type string, pr_state string, event_timestamp timestamp")
    said = [(f"u{rnd.randrange(20)}", rnd.randrange(80), rnd.choice([2, None])) for _ in range(60)] + [("nobody", 3, 1), (None, 4, 1)]
    weekly = series.weekly_contribution_metrics(events, comments=spark.createDataFrame(said, "person string, event_week int, comments int"))
    want = {}
    for p in {r[0] for r in rows}:
        weeks = [r[1] for r in rows if r[0] == p and r[1] is not None]
        for w in range(min(weeks), max(weeks) + 1):
            own = [r for r in rows if r[:2] == (p, w) and p]
            told = sum(r[2] or 0 for r in said if r[:2] == (p, w) and p)
            want[p, w] = (sum(r[2] == "commit" for r in own), sum(r[2:4] == ("pull_request", "merged") for r in own), sum(r[2] == "issue" for r in own), min(7, len({r[4].date() for r in own})), told)
    assert {(r[0], r[1]): r[2:] for r in weekly.collect()} == want
    assert weekly.dtypes == [("person", "string"), ("week_num", "int"), *[(c, "bigint") for c in ("commits", "prs_merged", "issues_opened", "active_days", "comments")]]
    for name in ("weekly_contribution_metrics", "contribution_index", "monthly_contribution"):
        text = plan(views_query(name, spark))
        above = text[: text.index("Generate explode(")]
        assert "Exchange" not in above and "Join" not in above, name
        assert "REPARTITION_BY_NUM" in text, name


def test_messages_alone_are_read_without_the_rest_of_a_payload(spark):
    timeline = q_treatment._json_timeline(spark, DIR)
    items, said = threads.thread_tables(timeline)
    alone = threads.thread_messages(timeline)
    assert alone.dtypes == said.dtypes and plain(alone, *said.columns) == plain(said, *said.columns) and said.count() > 5000
    few_items, few = threads.thread_tables(timeline, only=("n_messages", "author", "replied_at"))
    about = ["person", "thread_id", "event_type", "created_at", "item_author"]
    assert few_items.columns == [*about, "n_messages"] and few.columns == [*about, "pos", "author", "replied_at"]
    assert plain(few, *few.columns) == plain(said, *few.columns) and plain(few_items, *few_items.columns) == plain(items, *few_items.columns)
    assert plain(treatment.response_timing(few_items, few), "*") == plain(treatment.response_timing(items, said), "*")
    text = plan(views_query("extract_conversations", spark))
    assert "BroadcastExchange" not in text and "requestedReviewers" not in text and text.count("tryParseJson") + text.count("parseJson") + text.count("parse_json") == 1
