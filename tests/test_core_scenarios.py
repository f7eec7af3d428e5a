"""Scenarios with known results."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trailmark.operators import core, series, stats

SCHEMA = "project_name string, project_type string, author_email string, commit_hash string, commit_date timestamp"


def commits(spark, rows):
    out = [("p", "A", who, f"{who}{at}{i}", at + timedelta(hours=i)) for who, at, n in rows for i in range(n)]
    return spark.createDataFrame(out, SCHEMA)


MONDAY = datetime(2023, 1, 2)


def test_basic_timeline(spark):
    rows = [("alice", MONDAY, 5), ("bob", MONDAY, 3), ("charlie", MONDAY, 2)] + [(w, MONDAY + timedelta(days=7), n) for w, n in (("alice", 3), ("bob", 2), ("charlie", 1))]
    got = {r.week_number: r for r in core.core_timeline_weekly(commits(spark, rows)).collect()}
    assert got[1].commits_to_date == 10 and got[1].core == ["alice", "bob"]
    assert got[2].commits_to_date == 16 and got[2].core == ["alice", "bob"]


def test_exactly_80_percent(spark):
    rows = [(f"user{i}", MONDAY, n) for i, n in enumerate((20, 15, 10, 8, 7, 5, 4, 3, 2, 1))]
    counts = core.contributor_counts(commits(spark, rows))
    assert sorted(r.author_email for r in core.core_members(counts).collect()) == [f"user{i}" for i in range(5)]
    assert core.core_members(counts, rule="plus_one").count() == 6


def test_single_and_empty(spark):
    assert [r.core for r in core.core_timeline_weekly(commits(spark, [("a", MONDAY, 1)])).collect()] == [["a"]]
    assert core.core_timeline_weekly(spark.createDataFrame([], SCHEMA)).count() == 0


def test_core_does_not_shrink_with_percent(spark):
    rows = [("alice", MONDAY, 5), ("bob", MONDAY, 3), ("charlie", MONDAY, 2)]
    counts = core.contributor_counts(commits(spark, rows))
    sizes = [core.core_members(counts, percent=p).count() for p in (50, 80, 90)]
    assert sizes == sorted(sizes)


def test_concentration_of_equal_counts(spark):
    counts = core.contributor_counts(commits(spark, [(f"u{i}", MONDAY, 4) for i in range(4)]))
    row = core.concentration(counts).first()
    assert abs(row.gini) < 1e-12 and row.bus_factor == 3 and row.casual == 4


def test_contribution_index_value(spark):
    row = spark.createDataFrame([(4, 0, 0, 0, 2, 0.25)], "commits int, prs_merged int, comments int, issues_opened int, active_days int, duration double")
    assert abs(row.select(series.contribution_index().alias("x")).first().x - 1.067857) < 1e-6


def test_rank_statistics_against_pairs(spark):
    a, b = [1.0, 2.0, 2.0, 5.0, 7.0], [2.0, 3.0, 3.0, 4.0]
    frame = spark.createDataFrame([("A", x) for x in a] + [("B", x) for x in b], "g string, x double")
    gt, lt = sum(x > y for x in a for y in b), sum(x < y for x in a for y in b)
    assert stats.mann_whitney_u(frame, "g", "x", "A", "B").first().u == gt + (20 - gt - lt) / 2
    assert abs(stats.cliffs_delta_strict(frame, "g", "x", "A", "B").first().delta - (2 * gt / 20 - 1)) < 1e-12
    assert abs(stats.cliffs_delta_ties(frame, "g", "x", "A", "B").first().delta - (lt - gt) / 20) < 1e-12


def test_resample_keeps_ends(spark):
    frame = spark.createDataFrame([("a", [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 0.0])], "person string, series array<double>")
    row = series.resample_series(series.trim_active_segment(frame), 11, sparse=0).first()
    assert row.series[0] == 1.0 and row.series[-1] == 6.0 and abs(row.series[5] - 3.5) < 1e-9
    assert frame.select(F.size("series").alias("n")).first().n == 8


def test_large_projects_get_several_json_documents(spark, monkeypatch, tmp_path):
    from trailmark.plans import q_sources
    from trailmark.plans.views import commits

    monkeypatch.setattr(q_sources, "COMMITS_A_DOCUMENT", 10, raising=False)
    monkeypatch.setattr(q_sources, "_place", lambda spark, name: str(tmp_path / name))
    got = q_sources.scan_commit_json(spark, "/root/testdata/sf0.001")
    held = [len(r.commits) for r in spark.read.option("multiLine", True).json(str(tmp_path / "commits-json")).collect()]
    whole = commits(spark, "/root/testdata/sf0.001").select(q_sources.COLUMNS.split(", "))
    assert max(held) <= 40 and sum(held) == whole.count()
    assert got.exceptAll(whole).count() == 0 and whole.exceptAll(got).count() == 0
