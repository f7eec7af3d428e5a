"""Checks of the weekly table on planted violations against plain Python, and the plan that must not shuffle the dense grid."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators import activity, checks, core
from trailmark.plans.catalog import QUERIES

SCHEMA = "project_name string, project_type string, author_email string, week_number int, week_date date, commits_this_week bigint, cumulative_commits bigint, contribution_percentage double, is_core_this_week boolean"
ORDER = ["null_keys", "cumulative_falls", "cumulative_not_sum", "week_not_next", "share_out_of_range", "negative_commits", "core_flag_unlike_timeline"]


def rows_of(rnd, faults):
    """A clean table of 12 people over 70 weeks at most, with so many faults."""
    out = []
    for p in range(12):
        cumulative, start = 0, rnd.randrange(1, 40)
        for w in range(start, 71):
            k = rnd.choice([1, 2, 3]) if w == start or rnd.random() < 0.1 else 0
            cumulative += k
            out.append([f"p{p % 2}", "A", f"u{p}", w, datetime.date(2020, 1, 6) + datetime.timedelta(days=7 * w), k, cumulative, 50.0, w % 9 < 5])
    for _ in range(faults):
        i, kind = rnd.randrange(len(out)), rnd.randrange(11)
        if kind == 0:
            out[i][rnd.choice([0, 2, 3, 4, 5, 6, 7, 8])] = None
        elif kind == 1:
            out.append(list(out[i]))
        elif kind == 2:
            del out[i]
        elif kind == 3:
            out[i][6] += rnd.choice([-1, 1])
        elif kind == 4:
            out[i][5] = rnd.choice([-1, 4])
        elif kind == 5:
            out[i][7] = rnd.choice([-0.5, 100.5])
        elif kind == 6:
            out[i][8] = not out[i][8]
        elif kind == 7:
            out[i][4] += datetime.timedelta(days=rnd.choice([1, 7]))
        elif kind == 8:
            out[i][3] += rnd.choice([-2, 3])
        elif kind == 9:
            out.append([*out[i][:5], 1, (out[i][6] or 0) + 1, *out[i][7:]])
        else:
            j = rnd.randrange(len(out))
            out[i], out[j] = out[j], out[i]
    return out


def counted(rows, listed):
    """The seven figures, row by row; a null makes a test pass, and nulls come first in an order."""
    first = lambda x: (x is not None, x or 0)
    n = dict.fromkeys(ORDER, 0)
    for person in {tuple(r[:3]) for r in rows}:
        total, before, week_before, any_commits = 0, None, None, False
        for r in sorted((r for r in rows if tuple(r[:3]) == person), key=lambda r: (first(r[3]), first(r[6]), first(r[5]))):
            project, _, email, week, day, k, cumulative, share, flag = r
            total, any_commits = total + (k or 0), any_commits or k is not None
            n["null_keys"] += project is None or email is None or day is None
            n["cumulative_falls"] += None not in (cumulative, before) and cumulative < before
            n["cumulative_not_sum"] += cumulative is not None and any_commits and cumulative != total
            n["week_not_next"] += None not in (week, week_before) and week != week_before + 1
            n["share_out_of_range"] += share is not None and not 0 <= share <= 100
            n["negative_commits"] += k is not None and k < 0
            n["core_flag_unlike_timeline"] += flag is not None and flag != ((project, email, day) in listed)
            before, week_before = cumulative, week
    return n


@pytest.mark.parametrize("faults", [0, 1, 12, 80, 400])
def test_planted_violations_are_counted_as_row_by_row(spark, faults):
    rnd = random.Random(faults)
    rows = rows_of(rnd, faults)
    listed = {(r[0], r[2], r[4]) for r in rows if r[8] and None not in (r[0], r[2], r[4]) and (not faults or rnd.random() < 0.97)}
    table = spark.createDataFrame(rows, SCHEMA).repartition(1 if faults < 80 else 3)
    by_week = {}
    for project, email, day in listed:
        by_week.setdefault((project, day), []).append(email)
    timeline = spark.createDataFrame([(*k, v) for k, v in by_week.items()], "project_name string, week_date date, core array<string>")
    spans = []  # runs of a few weeks
    for project, email, day in sorted(listed):
        last = spans[-1] if spans else None
        if last and last[:2] == [project, email] and last[3] < 4 and day == last[2] + datetime.timedelta(days=7 * last[3]):
            last[3] += 1
        else:
            spans.append([project, email, day, 1])
    want = counted(rows, listed)
    assert faults == 1 or (sum(want.values()) > 0) == (faults > 1)
    found = checks.activity_checks(table, spark.createDataFrame(spans, "project_name string, author_email string, week_date date, weeks bigint"))
    assert found.dtypes == [("check", "string"), ("violations", "bigint")]
    assert dict(found.collect()) == want
    assert [tuple(r) for r in checks.core_flag_check(table, timeline).collect()] == [(ORDER[-1], want[ORDER[-1]])]
    assert dict(checks.activity_checks(table.drop("is_core_this_week")).collect()) == {k: want[k] for k in ORDER[:-1]}
    assert dict(checks.activity_checks(table.limit(0)).collect()) == dict.fromkeys(ORDER[:-1], 0)


def test_core_runs_list_the_weeks_of_the_timeline(spark):
    rnd, start = random.Random(5), datetime.datetime(2020, 1, 6)
    c = [(rnd.choice("pq"), "A", f"{rnd.choice('abcdef')}{int(rnd.expovariate(0.7))}", start + datetime.timedelta(days=rnd.randrange(500))) for _ in range(400)]
    commits = spark.createDataFrame(c, "project_name string, project_type string, author_email string, commit_date timestamp")
    found = sorted((r[0], r[1], r[2] + datetime.timedelta(days=7 * i)) for r in core.core_runs(commits).collect() for i in range(r[3]))
    listed = core.core_timeline_weekly(commits).select("project_name", F.explode("core"), "week_date")
    assert found == sorted(map(tuple, listed.collect())) and len(found) > 500


def test_the_last_core_is_that_of_the_timelines_last_week(spark):
    rnd, start = random.Random(9), datetime.datetime(2020, 1, 6)
    c = [(rnd.choice("pqr"), "A", f"{rnd.choice('abcdef')}{int(rnd.expovariate(0.3))}", start + datetime.timedelta(days=rnd.randrange(500))) for _ in range(300)]
    c += [("tied", "A", f"t{i:02d}", start + datetime.timedelta(days=i)) for i in range(30)] + [("one", "A", "u", start), (None, "A", "u", start), ("p", "A", None, start)]
    commits = spark.createDataFrame(c, "project_name string, project_type string, author_email string, commit_date timestamp")
    counts, timeline = core.contributor_counts(commits).persist(), core.core_timeline_weekly(commits)
    for percent in (50, 80):
        weekly = core.core_timeline_weekly(commits, percent)
        last = weekly.groupBy("project_name").agg(F.max_by("core", "week_date").alias("core")).select("project_name", F.explode("core"))
        found = sorted((r[0], r[1]) for r in core.last_core(counts, percent).collect() if r[1] is not None)
        assert found == sorted(map(tuple, last.collect())) and len({r[0] for r in found}) == 5
    rows = lambda frame: sorted(map(str, frame.select("project_name", "commits", "core_commits", "percent").collect()))
    found = checks.coverage_of(core.last_core(counts), counts)
    assert rows(found) == rows(checks.core_coverage(timeline, commits))
    assert {r.project_name: (r.commits, r.core_commits, r.percent) for r in found.collect()}["tied"] == (30, 24, 80.0)


def test_the_coverage_check_lists_no_core_for_each_week(spark):
    text = QUERIES["core_coverage_check"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "max_by" not in text and "collect_list(author_email" not in text and "explode(core_steps" not in text


def test_without_hashes_the_activity_is_the_same_but_for_them(spark):
    rnd, start = random.Random(6), datetime.datetime(2020, 1, 6)
    c = [("p", "A", f"u{rnd.randrange(9)}", str(i), start + datetime.timedelta(days=rnd.randrange(200)), 1, 2, 3) for i in range(60)]
    commits = spark.createDataFrame(c, "project_name string, project_type string, author_email string, commit_hash string, commit_date timestamp, total_insertions long, total_deletions long, files_modified_count long")
    whole, less = activity.contributor_activity(commits), activity.contributor_activity(commits.drop("commit_hash"))
    assert less.columns == [x for x in whole.columns if x != "commit_hashes"]
    assert sorted(map(str, less.collect())) == sorted(map(str, whole.select(less.columns).collect()))


def test_the_checks_do_not_shuffle_or_sort_the_grid(spark):
    text = QUERIES["data_checks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Generate explode(slice(_levels") == 1
    above = text[: text.index("Generate explode(slice(_levels")]
    after_runs = above[above.index("MapInArrow") :]
    assert "Exchange" not in after_runs and "Sort" not in after_runs and "Window" not in after_runs


def test_transition_violations_are_counted(spark):
    rows = [("p", "A", "ok", False, 3, 5, True, 5), ("p", "A", "cens", True, 3, 5, True, 5), ("p", "A", "neg", True, None, -1, False, None), ("p", "A", "time", False, 3, 4, True, 5)]
    rows += [("p", "A", "twice", True, None, 2, False, None)] * 2 + [(None, "A", None, None, None, -2, None, 5)]
    t = spark.createDataFrame(rows, "project_name string, project_type string, author_email string, censored boolean, first_core_week int, time_to_event_weeks int, became_core boolean, weeks_to_core int")
    assert dict(checks.transition_checks(t).collect()) == {"censored_unlike_core": 1, "negative_time": 2, "event_time_unlike_weeks": 1, "duplicate_people": 1}
    assert dict(checks.transition_checks(t.limit(0)).collect()) == dict.fromkeys(["censored_unlike_core", "negative_time", "event_time_unlike_weeks", "duplicate_people"], 0)
