"""Milestones and owners on the cases that tell the surveyed rules from near ones."""

import datetime

import pytest

from trailmark.operators import milestones, projects
from pyspark.sql import functions as F  # isort: skip

DAY = datetime.datetime(2024, 1, 1, 12)


def timeline(spark, rows):
    """rows: (type, state, day, text)."""
    return spark.createDataFrame([("p", i, kind, state, DAY + datetime.timedelta(days=d), text) for i, (kind, state, d, text) in enumerate(rows)], "person string, event_id int, event_type string, pr_state string, event_timestamp timestamp, text string")


def v1(spark, rows, reviews=(), comments=()):
    r = spark.createDataFrame(list(reviews), "person string, event_id int, owner string")
    c = spark.createDataFrame(list(comments), "person string, event_id int, owner string, body string")
    return milestones.milestones_v1(timeline(spark, rows), r, c).first()


def test_only_merged_requests_and_commits_are_contributions(spark):
    assert v1(spark, [("issue", None, d, "") for d in range(5)]).sustained_at is None
    assert v1(spark, [("pull_request", "open", d, "") for d in range(6)]).sustained_at is None
    got = v1(spark, [("issue", None, 0, ""), ("commit", None, 1, "a"), ("commit", None, 2, "b"), ("pull_request", "merged", 3, "c"), ("commit", None, 4, "d"), ("issue", None, 5, ""), ("commit", None, 91, "e"), ("commit", None, 95, "f")])
    assert got.sustained_at == DAY + datetime.timedelta(days=91) and got.sustained_week == 12
    assert v1(spark, [("commit", None, 30 * k, "x") for k in range(5)]).sustained_at is None


@pytest.mark.parametrize(("body", "helps"), [("you should see this example", True), ("TRY again", True), ("prefixed", True), ("help", False), ("works", False), (None, False)])
def test_helpful_words_lie_anywhere(spark, body, helps):
    rows = [("commit", None, 0, "a"), ("issue", None, 3, ""), ("issue", None, 9, "")]
    got = v1(spark, rows, comments=[("p", 2, "other", body), ("p", 1, "p", body), ("p", 1, None, body), ("p", 0, "other", body)])
    assert (got.helped_at == DAY + datetime.timedelta(days=9)) if helps else got.helped_at is None


def test_areas_come_from_the_text(spark):
    same = [("commit", None, 0, "add test"), ("issue", None, 1, "docs"), ("pull_request", "open", 2, "more tests")]
    assert v1(spark, same).crossed_at is None
    assert v1(spark, [*same, ("commit", None, 8, "coverage of docs")]).crossed_week == 1
    # A request's title has fewer key words than a commit's message.
    assert v1(spark, [("commit", None, 0, "readme"), ("pull_request", "open", 1, "readme")]).crossed_at is not None


def test_recovery_reviews_and_returns(spark):
    rows = [("pull_request", "merged", 0, ""), ("pull_request", "rejected", 1, ""), ("commit", None, 32, ""), ("pull_request", "merged", 32, "")]
    got = v1(spark, rows, reviews=[("p", 0, "p"), ("p", 2, "other"), ("p", 3, "other")])
    assert (got.accepted_at, got.recovered_at, got.reviewed_at) == (DAY, DAY + datetime.timedelta(days=32), DAY + datetime.timedelta(days=32))
    assert v1(spark, [("pull_request", "merged", 0, ""), ("pull_request", "open", 1, "")]).recovered_at is None
    assert got.returned_at is not None and v1(spark, [("commit", None, 0, ""), ("commit", None, 30, "")]).returned_at is None


def test_a_given_event_week_is_kept(spark):
    rows = timeline(spark, [("issue", None, 0, ""), ("pull_request", "merged", 28, "")]).withColumn("event_week", F.col("event_id") + 43)
    assert milestones.first_merged_pr(rows).first().first_merged_week == 44
    counted = milestones.with_event_week(timeline(spark, [("issue", None, 0, ""), ("commit", None, 14, ""), ("commit", None, 30, "")])).orderBy("event_id").collect()
    assert [r.event_week for r in counted] == [-2, 0, 2]
    many = timeline(spark, [("commit", None, 7 * d, "") for d in range(12)]).withColumn("event_week", F.col("event_id") + 20)
    assert milestones.sustained_participation(many).first().sustained_week == 31
    seq = milestones.milestone_sequences(milestones.all_milestones(many)).first()
    assert "SustainedParticipation12w" in seq.sequence


def test_owners(spark):
    want = {"docker/y": "company-backed", "github/y": "company-backed", "amazon/y": "community-led", "A-Foundation-B/y": "community-led", "numfocus/y": "community-led", "/y": "unknown", None: "unknown"}
    got = spark.createDataFrame([(k,) for k in want], "p string").select("p", projects.owner_class(F.col("p")).alias("c")).collect()
    assert {r.p: r.c for r in got} == want
    own = spark.createDataFrame([("mine/x",)], "p string").select(projects.owner_class(F.col("p"), companies=("mine",)).alias("c")).first().c
    assert own == "company-backed"
