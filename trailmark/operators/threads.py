"""Event timelines and the threads in them: JSON payloads of several shapes become one table of messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import clean_email, count_if
from trailmark.operators.stats import on_keys, quantiles
from trailmark.operators.written import written

#: Timeline items that are messages.
MESSAGE_KINDS = ("IssueComment", "PullRequestReview")


def parsed(json: Column) -> Column:
    """The payload as a variant; null for empty or broken JSON."""
    return F.try_parse_json(json)


def text_at(v: Column, *paths: str) -> Column:
    """The first path that holds a string."""
    return F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])


def _array_at(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in paths])


def extract_author(v: Column, path: str = "$") -> Column:
    """The login of author, user or actor, or an author that is a plain string."""
    login = text_at(v, f"{path}.author.login", f"{path}.user.login", f"{path}.actor.login")
    plain = F.try_variant_get(v, f"{path}.author", "string")
    return F.coalesce(login, F.when(~plain.startswith("{"), plain))


def _message(v: Column, only: Sequence[str] = ("author", "timestamp", "body", "role")) -> Column:
    fields = {
        "author": extract_author(v),
        "timestamp": F.try_to_timestamp(text_at(v, "$.timestamp", "$.createdAt", "$.created_at", "$.submittedAt", "$.submitted_at")),
        "body": F.coalesce(text_at(v, "$.body"), F.lit("")),
        "role": F.coalesce(text_at(v, "$.role", "$.authorAssociation", "$.author_association"), F.lit("NONE")),
    }
    return F.struct(*[fields[c].alias(c) for c in only])


def _messages(v: Column) -> Column:
    """The messages as variants: the conversations, or else the comments (nodes or a plain list), and then the timeline items of
    MESSAGE_KINDS. Empty for payloads without any."""
    empty = F.array().cast("array<variant>")
    items = _array_at(v, "$.timelineEvents.nodes", "$.timelineEvents")
    kept = F.filter(items, lambda x: F.try_variant_get(x, "$.__typename", "string").isin(*MESSAGE_KINDS))
    return F.concat(F.coalesce(_array_at(v, "$.conversations", "$.comments.nodes", "$.comments"), empty), F.coalesce(kept, empty))


def extract_conversations(v: Column, only: Sequence[str] = ("author", "timestamp", "body", "role")) -> Column:
    """array<struct<author, timestamp, body, role>> of the payload's messages, or of the named fields."""
    return F.transform(_messages(v), lambda m: _message(m, only))


def list_size(v: Column, *names: str) -> Column:
    """Members of the first of the named lists that exists, given plainly or as nodes; 0 without one."""
    paths = [p for n in names for p in (f"$.{n}.nodes", f"$.{n}")]
    return F.coalesce(F.size(_array_at(v, *paths)), F.lit(0))


def pr_state(v: Column) -> Column:
    """merged, rejected (closed unmerged), or open."""
    merged = F.coalesce(F.try_variant_get(v, "$.merged", "boolean"), F.lit(False)) | text_at(v, "$.mergedAt", "$.merged_at").isNotNull()
    state = F.upper(F.coalesce(text_at(v, "$.state", "$.stateStr"), F.lit("")))
    return F.when(merged | (state == "MERGED"), "merged").when(state == "CLOSED", "rejected").otherwise("open")


def project_type_lookup(pairs: DataFrame, commits: DataFrame) -> DataFrame:
    """(project_name, author_email) with the type of that pair's commits, else any type of the project, else UNKNOWN."""
    own = commits.groupBy("project_name", clean_email(F.col("author_email")).alias("email_key")).agg(F.min("project_type").alias("own"))
    any_of = commits.groupBy("project_name").agg(F.min("project_type").alias("any_type"))
    out = pairs.withColumn("email_key", clean_email(F.col("author_email"))).join(own, ["project_name", "email_key"], "left").join(any_of, "project_name", "left")
    return out.select(*pairs.columns, F.coalesce("own", "any_type", F.lit("UNKNOWN")).alias("project_type"))


def build_timeline(events: DataFrame, commits: DataFrame, first_core: DataFrame) -> DataFrame:
    """Threads and commits of the listed people as one timeline.

    events: project_name, author_email, event_type, event_timestamp, event_identifier, event_data. first_core: the people
    (project_name, author_email) with first_core_date, null if never core. E-mails meet case-insensitively. event_week is
    whole weeks since the person's first commit (null without one); is_pre_core: before the first core date, or no such
    date; event_id numbers a person's events by time and identifier from 0.
    """
    keys = ["project_name", "author_email"]
    low = lambda f: f.withColumn("author_email", clean_email(F.col("author_email")))
    people = low(first_core).groupBy(*keys).agg(F.min("first_core_date").alias("first_core_date"))
    c = low(commits).join(people.select(*keys), keys, "left_semi")
    first = c.groupBy(*keys).agg(F.min("commit_date").alias("first_commit"))
    as_events = c.select(*keys, F.lit("commit").alias("event_type"), F.col("commit_date").alias("event_timestamp"), F.col("commit_hash").alias("event_identifier"), F.lit(None).cast("string").alias("event_data"))
    both = low(events).select(as_events.columns).unionByName(as_events).join(people, keys).join(first, keys, "left")
    order = Window.partitionBy(*keys).orderBy("event_timestamp", "event_identifier", "event_type")
    week = F.floor(F.datediff("event_timestamp", "first_commit") / 7).cast("int")
    pre = F.col("first_core_date").isNull() | (F.col("event_timestamp") < F.col("first_core_date"))
    return both.select(*keys, "event_type", "event_timestamp", "event_identifier", "event_data", week.alias("event_week"), pre.alias("is_pre_core"), (F.row_number().over(order) - 1).alias("event_id"))


def _threads(timeline: DataFrame) -> DataFrame:
    """The timeline's pull requests and issues with v, the parsed payload (null for a broken one: a test of that here would be put
    below and parse every payload once more), created_at and item_author."""
    v = F.col("v")
    rows = timeline.where(F.col("event_type").isin("pull_request", "issue")).withColumn("v", parsed(F.col("event_data")))
    created = F.coalesce(F.try_to_timestamp(text_at(v, "$.created_at", "$.createdAt")), F.col("event_timestamp"))
    return rows.withColumn("created_at", created).withColumn("item_author", extract_author(v))


def thread_messages(timeline: DataFrame, keys: Sequence[str] = ("person",)) -> DataFrame:
    """The messages of thread_tables alone, in one pass: nothing else of a payload is read, and no table is written."""
    flat = _threads(timeline).select(*keys, F.col("event_id").alias("thread_id"), "event_type", "created_at", "item_author", F.posexplode(_messages(F.col("v"))).alias("pos", "v"))
    m = flat.withColumn("m", _message(F.col("v")))
    return m.select(*keys, "thread_id", "event_type", "created_at", "item_author", "pos", "m.author", F.col("m.timestamp").alias("replied_at"), "m.body", "m.role")


def thread_tables(timeline: DataFrame, keys: Sequence[str] = ("person",), only: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, messages) of a timeline's pull requests and issues.

    items: keys, thread_id, event_type, created_at, item_author, state, and the counts that trust_indicators reads;
    messages: keys, thread_id, event_type, created_at, item_author, pos, author, replied_at, body, role. With `only`, of the
    columns after item_author (but pos) just the named ones, in both tables, are read from the payloads and written.
    """
    v = F.col("v")
    reviews = _array_at(v, "$.reviews.nodes", "$.reviews")
    approvals = F.filter(reviews, lambda r: text_at(r, "$.state", "$.stateStr") == "APPROVED")
    hours = F.transform(approvals, lambda r: (F.unix_seconds(F.try_to_timestamp(text_at(r, "$.submittedAt", "$.submitted_at"))) - F.unix_seconds("created_at")) / 3600.0)
    labels = F.transform(_array_at(v, "$.labels.nodes", "$.labels"), lambda x: F.lower(F.coalesce(text_at(x, "$.name"), F.try_variant_get(x, "$", "string"))))
    facts = {
        "state": pr_state(v),
        "n_messages": F.size("messages"),
        "n_reviews": F.coalesce(F.size(reviews), F.lit(0)),
        "reviewers": F.coalesce(F.transform(reviews, lambda r: extract_author(r)), F.array().cast("array<string>")),
        "n_approvals": F.coalesce(F.size(approvals), F.lit(0)),
        "approval_hours": F.coalesce(F.filter(hours, lambda h: h >= 0), F.array().cast("array<double>")),
        "n_rejections": F.coalesce(F.size(F.filter(reviews, lambda r: text_at(r, "$.state", "$.stateStr").isin("CHANGES_REQUESTED", "REQUEST_CHANGES"))), F.lit(0)),
        "merged_by_author": extract_author(v, "$.mergedBy"),
        "merged_by": text_at(v, "$.mergedBy.login"),
        "n_requested": list_size(v, "requestedReviewers", "requested_reviewers"),
        "labels": F.coalesce(labels, F.array().cast("array<string>")),
        "has_milestone": F.try_variant_get(v, "$.milestone", "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get(v, "$.milestone", "variant")),
        "n_projects": list_size(v, "projectCards", "project_cards"),
        "n_assignees": list_size(v, "assignees"),
        "administrative": text_at(v, "$.closedBy.login", "$.mergedBy.login").isNotNull(),
    }
    said = {c: c.replace("replied_at", "timestamp") for c in ("author", "replied_at", "body", "role") if only is None or c in only}
    rows = _threads(timeline).withColumn("messages", extract_conversations(v, list(said.values()) or ["author"]))
    # Both tables come from one pass over the payloads.
    about = [*keys, "thread_id", "event_type", "created_at", "item_author"]
    own = [f.alias(c) for c, f in facts.items() if only is None or c in only]
    rows = written(rows.withColumn("thread_id", F.col("event_id")).select(*about, *own, "messages", v.isNotNull().alias("whole"))).where("whole").drop("whole")
    items, flat = rows.drop("messages"), rows.select(*about, F.posexplode("messages").alias("pos", "m"))
    return items, flat.select(*about, "pos", *[F.col(f"m.{of}").alias(c) for c, of in said.items()])


def comment_counts(items: DataFrame, keys: Sequence[str] = ("person",)) -> DataFrame:
    """keys, prs, issues, pr_comments (messages and reviews), issue_comments, avg_pr_comments, avg_issue_comments."""
    pr = F.col("event_type") == "pull_request"
    out = items.groupBy(*keys).agg(count_if(pr).alias("prs"), count_if(~pr).alias("issues"), F.sum(F.when(pr, F.col("n_messages") + F.col("n_reviews")).otherwise(0)).alias("pr_comments"), F.sum(F.when(~pr, F.col("n_messages")).otherwise(0)).alias("issue_comments"))
    mean = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.withColumn("avg_pr_comments", mean("pr_comments", "prs")).withColumn("avg_issue_comments", mean("issue_comments", "issues"))


def timeline_summary(timeline: DataFrame, keys: Sequence[str] = ("person",), kinds: Sequence[str] = ("commit", "issue", "pull_request"), week: str | None = None) -> DataFrame:
    """keys, events, an n_<kind> for each kind, first_event, last_event, weeks_span and, of a timeline with is_pre_core,
    pre_core_events and post_core_events."""
    span = F.floor(F.datediff(F.max("event_timestamp"), F.min("event_timestamp")) / 7).cast("int") if week is None else F.max(week) - F.min(week)
    counts = [count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds]
    core = [count_if(F.col("is_pre_core")).alias("pre_core_events"), count_if(~F.col("is_pre_core")).alias("post_core_events")] if "is_pre_core" in timeline.columns else []
    return timeline.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), *counts, F.min("event_timestamp").alias("first_event"), F.max("event_timestamp").alias("last_event"), span.alias("weeks_span"), *core)


def timeline_outliers(summary: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("person",), fence: float = 1.5, most_z: float = 3.0) -> DataFrame:
    """keys and the metrics (array) in which a person lies outside the quartile fences or more than `most_z` population
    standard deviations from the mean. Drop these people with a left_anti join."""
    long = summary.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(keys), list(metrics), "metric", "x")
    q = on_keys(long.groupBy("metric").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")), quantiles(long, ["metric"], "x", {"q25": 0.25, "q75": 0.75}), ["metric"])
    both = long.join(F.broadcast(q), "metric")  # a row for each metric
    spread = F.col("q75") - F.col("q25")
    outside = (F.col("x") < F.col("q25") - fence * spread) | (F.col("x") > F.col("q75") + fence * spread)
    far = (F.col("s") > 0) & (F.abs(F.col("x") - F.col("m")) / F.col("s") > most_z)
    return both.where(outside | far).groupBy(*keys).agg(F.sort_array(F.collect_list("metric")).alias("outlier_metrics"))
