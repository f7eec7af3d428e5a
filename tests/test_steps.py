"""The change-point core against the dense grid and against a plain recount."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trailmark.operators import activity, core, journeys, steps


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    rnd, start = random.Random(request.param), datetime.datetime(2020, 1, 6)
    out = []
    for k in range(400):
        project = rnd.choice(["p", "p", "q"])
        person = f"{rnd.choice('abcdefgh')}{int(rnd.expovariate(0.7))}"
        when = start + datetime.timedelta(days=rnd.randrange(7 * 30), hours=rnd.randrange(24))
        out.append((project, "A" if project == "p" else "B", person, str(k), when, rnd.randrange(9), rnd.randrange(9), 1))
    return [*out, ("one", "A", "z", "x", start, 1, 1, 1)]


@pytest.fixture(scope="module")
def commits(spark, rows):
    names = "project_name string, project_type string, author_email string, commit_hash string, commit_date timestamp, total_insertions long, total_deletions long, files_modified_count long"
    return spark.createDataFrame(rows, names)


def test_journeys_equal_those_of_the_dense_grid(commits):
    sparse = journeys.contributor_journeys(commits)
    dense = journeys.contributor_transitions(activity.contributor_activity(commits))
    assert sorted((f.name, f.dataType.typeName()) for f in sparse.schema) == sorted((f.name, f.dataType.typeName()) for f in dense.schema)
    cols = [F.round(f.name, 9).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in dense.schema]
    plain = lambda t: sorted(map(str, t.select(cols).collect()))
    assert plain(sparse) == plain(dense)


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_timeline_equals_a_recount_of_each_week(commits, rows, percent):
    got = {(r.project_name, r.week_date): r for r in core.core_timeline_weekly(commits, percent).collect()}
    seen = 0
    for project in {r[0] for r in rows}:
        own = [(r[2], (r[4] - datetime.timedelta(days=r[4].weekday())).date()) for r in rows if r[0] == project]
        week, last, number = min(w for _, w in own), max(w for _, w in own), 1
        while week <= last:
            counts = {}
            for person, w in own:
                if w <= week:
                    counts[person] = counts.get(person, 0) + 1
            total, cum, members = sum(counts.values()), 0, []
            for person, n in sorted(counts.items(), key=lambda e: (-e[1], e[0])):
                if cum * 100 < total * percent:
                    members.append(person)
                cum += n
            r = got[project, week]
            assert (r.week_number, r.commits_to_date, r.contributors_to_date, r.core) == (number, total, len(counts), sorted(members))
            assert (r.core_size, r.core_min_commits) == (len(members), min(counts[m] for m in members))
            week, number, seen = week + datetime.timedelta(days=7), number + 1, seen + 1
    assert seen == len(got)


def test_no_commits_give_no_rows(commits):
    none = commits.where("false")
    assert journeys.contributor_journeys(none).count() == 0
    assert core.core_timeline_weekly(none).count() == 0
    assert core.core_monthly(none).count() == 0


def test_steps_are_tested_only_where_the_count_reaches_a_cut(spark):
    """A project of 40 busy people and 500 who commit once: whoever stays under all cuts of a block isn't tested there."""
    start = datetime.datetime(2015, 1, 5)
    rows = [("p", f"busy{i:02d}", start + datetime.timedelta(weeks=w)) for i in range(40) for w in range(200)]
    rows += [("p", f"once{i:04d}", start + datetime.timedelta(weeks=i % 100)) for i in range(500)]
    commits = spark.createDataFrame(rows, "project_name string, author_email string, commit_date timestamp").withColumn("week", F.floor(F.datediff("commit_date", F.lit(start).cast("date")) / 7) + 1)
    each = core.cumulative_counts(commits, F.col("week"))
    until = F.lead("period").over(Window.partitionBy("author_email").orderBy("period"))
    held = each.select("project_name", "author_email", F.col("n_to_date").alias("n"), F.col("period").alias("at"), F.coalesce(until, F.lit(201)).alias("until")).persist()
    cuts = steps.core_cuts(steps.count_levels(held, ["project_name"]), ["project_name"]).persist()
    found = steps.with_cuts(held, cuts, ["project_name"], ["level"]).withColumn("tested", F.size(steps.reached_blocks()) * steps.BLOCK)
    sums = found.groupBy(F.substring("author_email", 1, 4).alias("kind")).agg(F.sum("tested").alias("tested"), F.sum(F.col("until") - F.col("at")).alias("whole")).collect()
    once = next(r for r in sums if r.kind == "once")
    assert once.whole == sum(200 - i % 100 for i in range(500)) and once.tested < once.whole / 10
    core_weeks = steps.with_core_steps(held, cuts, ["project_name"]).agg(F.sum(F.size("core_steps"))).first()[0]
    assert sum(r.tested for r in sums) <= (core_weeks + held.count()) * steps.BLOCK
