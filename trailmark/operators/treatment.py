"""How people are treated in threads: five families of metrics per person, from the tables of threads.thread_tables.

Each family is one aggregate by person (a second one before it where pairs or threads have to be counted first). Null
authors are no responders; a reply counts as by another if its author isn't the thread's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import count_if, is_weekend
from trailmark.operators.stats import chi_square_of_counts, on_keys, quantiles

#: Roles, and the words, marks and phrases that the families look for.
MAINTAINER_ROLES = ("MEMBER", "OWNER", "MAINTAINER", "ADMIN")
PEER_ROLES = ("CONTRIBUTOR", "COLLABORATOR")
THANKS = r"(?i)\b(thank|thanks|thx|appreciate|grateful|kudos)\b"
PRAISE = r"(?i)\b(great|excellent|awesome|amazing|perfect|brilliant|fantastic|wonderful|good job|well done|nice work|impressive|outstanding)\b"
POSITIVE = r"(?i)\b(love|like|good|nice|helpful|useful|clear|clean|solid)\b"
GLAD = "😊|👍|❤️|🎉|✨|👏|🚀|💯|🙌|🔥|⭐|👌|😄|😃|🙂|👊"
SAD = "😞|😢|😭|💔|👎|😠|😡|🤔|😕|☹️"
DELEGATION = ("can you", "could you", "please", "would you mind", "assign", "take care")
SENSITIVE = ("security", "critical", "breaking", "release", "hotfix")
MENTION = r"@[\w-]+"


def _rate(test: Column) -> Column:
    return F.coalesce(F.avg(F.when(test, 1.0).otherwise(0.0)), F.lit(0.0))


def _spread(x: Column, name: str, *, quartiles: bool = False) -> list[Column]:
    q = [(F.percentile(x, F.lit(p)), f"{name}_{k}") for p, k in ((0.25, "q25"), (0.75, "q75"))] if quartiles else []
    stats = [(F.avg(x), f"{name}_mean"), (F.percentile(x, F.lit(0.5)), f"{name}_median"), (F.stddev_pop(x), f"{name}_std"), (F.min(x), f"{name}_min"), (F.max(x), f"{name}_max"), *q]
    return [c.alias(n) for c, n in stats]


def by_others(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("author").isNotNull() & (F.col("author") != "") & (F.col("item_author").isNull() | (F.col("author") != F.col("item_author"))))


def response_timing(items: DataFrame, messages: DataFrame, keys: Sequence[str] = ("person",)) -> DataFrame:
    """keys, items, items_with_responses (any message, own ones too), response_rate, responses, and hours from a thread's
    start to replies by others, none negative: first_* of the first in list order, all_* of all; shares on weekends, off
    hours (before 9, from 18), in business hours, within 1 and 24 hours."""
    hours = (F.unix_seconds("replied_at") - F.unix_seconds("created_at")) / 3600.0
    # Dealt by person once, for the threads' first replies and for the person's figures.
    replies = by_others(messages).withColumn("hours", hours).where("hours >= 0").select(*keys, "thread_id", "pos", "replied_at", "hours").repartition(*keys)
    replies = replies.withColumn("first", F.row_number().over(Window.partitionBy(*keys, "thread_id").orderBy("pos")) == 1)
    first, h, hour = F.when(F.col("first"), F.col("hours")), F.col("hours"), F.hour("replied_at")
    off = (hour < 9) | (hour >= 18)
    timing = replies.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("responses"),
        F.count(first).alias("first_count"),
        *_spread(first, "first", quartiles=True),
        *_spread(h, "all")[:3],
        _rate(is_weekend(F.col("replied_at"))).alias("weekend_rate"),
        _rate(off).alias("off_hours_rate"),
        _rate(~off).alias("business_hours_rate"),
        _rate(h <= 1).alias("within_hour_rate"),
        _rate(h <= 24).alias("same_day_rate"),
    )
    base = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), count_if(F.col("n_messages") > 0).alias("items_with_responses"), _rate(F.col("n_messages") > 0).alias("response_rate"))
    return base.join(timing, list(keys), "left").fillna(0, ["responses", "first_count", "weekend_rate", "off_hours_rate", "business_hours_rate", "within_hour_rate", "same_day_rate"])


def engagement_breadth(items: DataFrame, messages: DataFrame, keys: Sequence[str] = ("person",)) -> DataFrame:
    """keys, unique_responders, breadth_responses, unique_pr_responders, maintainer, peer and external shares (a review is
    by a maintainer), repeat_engagers (more than one pull request), mean and max pull requests a responder, diversity
    (Simpson), top_share, unique_roles and role_diversity by each responder's first role."""
    cols = [*keys, "thread_id", "event_type", "author", "role", "pos"]
    said = by_others(messages).select(*cols)
    reviews = items.select(*keys, "thread_id", "event_type", "item_author", F.posexplode("reviewers").alias("pos", "author")).withColumn("role", F.lit(None).cast("string"))
    both = said.unionByName(by_others(reviews.where("event_type = 'pull_request'")).select(*cols))
    pr = F.col("event_type") == "pull_request"
    first_role = F.min(F.when(F.col("role").isNotNull(), F.struct("thread_id", "pos", "role")))
    each = both.groupBy(*keys, "author").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.when(pr, F.col("thread_id"))).alias("prs"),
        count_if(F.col("role").isNull() | F.col("role").isin(*MAINTAINER_ROLES)).alias("maintainer"),
        count_if(F.coalesce(F.col("role").isin(*PEER_ROLES), F.lit(False))).alias("peer"),
        first_role["role"].alias("first_role"),
    )
    n = F.sum("n")
    out = each.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_responders"),
        n.alias("breadth_responses"),
        count_if(F.col("prs") > 0).alias("unique_pr_responders"),
        (F.sum("maintainer") / n).alias("maintainer_rate"),
        (F.sum("peer") / n).alias("peer_rate"),
        (1 - (F.sum("maintainer") + F.sum("peer")) / n).alias("external_rate"),
        count_if(F.col("prs") > 1).alias("repeat_engagers"),
        F.coalesce(F.avg(F.when(F.col("prs") > 0, F.col("prs"))), F.lit(0.0)).alias("avg_prs_per_responder"),
        F.max("prs").alias("max_prs_per_responder"),
        (1 - F.sum(F.col("n") * F.col("n")) / (n * n)).alias("diversity"),
        (F.max("n") / n).alias("top_share"),
    )
    roles = each.where("first_role is not null").groupBy(*keys, "first_role").agg(F.count(F.lit(1)).alias("k"))
    k = F.sum("k")
    roles = roles.groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_roles"), (1 - F.sum(F.col("k") * F.col("k")) / (k * k)).alias("role_diversity"))
    out = items.select(*keys).distinct().join(out, list(keys), "left").join(roles, list(keys), "left")
    return out.fillna(0)


def interaction_patterns(messages: DataFrame, keys: Sequence[str] = ("person",)) -> DataFrame:
    """keys, length_* (messages a thread), turns_* (changes of author, the thread's author first), words_*, sentences mean
    and median (marks . ! ?, one at least), messages (with text), shares with a question, link, code or mention, counts of
    snippets, external and internal links."""
    thread = [*keys, "thread_id"]
    named = F.when((F.col("author") != ""), F.col("author"))
    before = F.last(named, ignorenulls=True).over(Window.partitionBy(*thread).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = messages.withColumn("named", named).withColumn("turn", named.isNotNull() & ~named.eqNullSafe(F.coalesce(before, F.col("item_author"))))
    threads = rows.groupBy(*thread).agg(F.count(F.lit(1)).alias("length"), count_if(F.col("turn")).alias("turns"))
    shape = threads.groupBy(*keys).agg(*_spread(F.col("length"), "length"), *[c for c in _spread(F.col("turns"), "turns")])
    body = F.col("body")
    words = F.size(F.filter(F.split(body, r"\s+"), lambda w: w != ""))
    marks = F.greatest(F.lit(1), F.regexp_count(body, F.lit(r"[.!?]")))
    link = body.contains("http://") | body.contains("https://")
    fences = F.regexp_count(body, F.lit("```"))
    texts = messages.where(body != "").withColumn("w", words)
    talk = texts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("messages"),
        *_spread(F.col("w"), "words"),
        F.avg(marks).alias("sentences_mean"),
        F.percentile(marks, F.lit(0.5)).alias("sentences_median"),
        _rate(body.contains("?")).alias("question_rate"),
        _rate(link).alias("link_rate"),
        _rate(body.contains("`")).alias("code_rate"),
        _rate(body.rlike(MENTION)).alias("mention_rate"),
        F.sum(F.floor(fences / 2)).alias("code_snippets"),
        count_if(link & ~body.contains("github.com")).alias("external_links"),
        count_if(link & body.contains("github.com")).alias("internal_links"),
        F.coalesce(F.avg(F.when(F.col("w") > 0, F.col("w"))), F.lit(0.0)).alias("avg_words"),
    )
    return shape.join(talk, list(keys), "left")


def recognition_signals(items: DataFrame, messages: DataFrame, keys: Sequence[str] = ("person",)) -> DataFrame:
    """keys, recognition_messages (by others, with text), shares with thanks, praise, positive words or an emoji (each
    message once), merge, close, approval and rejection rates a pull request, attribution_rate (merged by another),
    approval_* hours, glad and sad emoji counts and their ratio."""
    body = F.col("body")
    said = by_others(messages).where(body != "").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("recognition_messages"),
        _rate(body.rlike(THANKS)).alias("thanks_rate"),
        _rate(body.rlike(PRAISE)).alias("praise_rate"),
        _rate(body.rlike(POSITIVE)).alias("positive_rate"),
        _rate(body.rlike(f"{GLAD}|{SAD}")).alias("emoji_rate"),
        F.sum(F.regexp_count(body, F.lit(GLAD))).cast("bigint").alias("glad_emojis"),
        F.sum(F.regexp_count(body, F.lit(SAD))).cast("bigint").alias("sad_emojis"),
    )
    pr = F.col("event_type") == "pull_request"
    merged = pr & (F.col("state") == "merged")
    another = merged & F.col("merged_by").isNotNull() & ~F.col("merged_by").eqNullSafe(F.col("item_author"))
    n = F.greatest(count_if(pr), F.lit(1))
    rates = items.groupBy(*keys).agg(
        count_if(pr).alias("prs"),
        (count_if(merged) / n).alias("merge_rate"),
        (count_if(pr & (F.col("state") == "rejected")) / n).alias("close_rate"),
        (F.sum(F.when(pr, F.col("n_approvals")).otherwise(0)) / n).alias("approval_rate"),
        (F.sum(F.when(pr, F.col("n_rejections")).otherwise(0)) / n).alias("rejection_rate"),
        (count_if(another) / F.greatest(count_if(merged), F.lit(1))).alias("attribution_rate"),
    )
    speed = items.where(pr).select(*keys, F.explode("approval_hours").alias("h")).groupBy(*keys).agg(*_spread(F.col("h"), "approval"))
    out = rates.join(said, list(keys), "left").join(speed, list(keys), "left")
    out = out.fillna(0, ["recognition_messages", "thanks_rate", "praise_rate", "positive_rate", "emoji_rate", "glad_emojis", "sad_emojis"])
    return out.withColumn("emoji_ratio", F.col("glad_emojis") / (F.col("sad_emojis") + 1))


def trust_indicators(items: DataFrame, messages: DataFrame, keys: Sequence[str] = ("person",)) -> DataFrame:
    """keys, review_requests, labels_added, sensitive_labels, milestones, project_assignments, assignments, mentions,
    delegated (messages with a request), re_engagements (reviews beyond the first), their rate, label, milestone and
    assignment rates, administrative, trust_score (requests + assignments + labels + 2 sensitive)."""
    pr = F.col("event_type") == "pull_request"
    sensitive = F.size(F.filter("labels", lambda x: x.rlike("|".join(SENSITIVE))))
    n_pr, n_issue = F.greatest(count_if(pr), F.lit(1)), F.greatest(count_if(~pr), F.lit(1))
    if_pr = lambda c: F.sum(F.when(pr, c).otherwise(0)).cast("bigint")
    counts = items.groupBy(*keys).agg(
        if_pr(F.col("n_requested")).alias("review_requests"),
        F.sum(F.size("labels")).cast("bigint").alias("labels_added"),
        if_pr(sensitive).alias("sensitive_labels"),
        count_if(F.col("has_milestone")).alias("milestones"),
        if_pr(F.col("n_projects")).alias("project_assignments"),
        F.sum(F.when(~pr, F.col("n_assignees")).otherwise(0)).cast("bigint").alias("assignments"),
        if_pr(F.greatest(F.col("n_reviews") - 1, F.lit(0))).alias("re_engagements"),
        (count_if(pr & (F.col("n_reviews") > 1)) / n_pr).alias("re_engagement_rate"),
        (count_if(pr & (F.size("labels") > 0)) / n_pr).alias("label_rate"),
        (count_if(pr & F.col("has_milestone")) / n_pr).alias("milestone_rate"),
        (count_if(~pr & (F.col("n_assignees") > 0)) / n_issue).alias("assignment_rate"),
        count_if(pr & F.col("administrative")).alias("administrative_actions"),
    )
    asks = F.lower("body").rlike("|".join(DELEGATION))
    said = messages.groupBy(*keys).agg(F.sum(F.regexp_count("body", F.lit(MENTION))).cast("bigint").alias("mentions"), count_if(asks).alias("delegated"))
    out = counts.join(said, list(keys), "left").fillna(0, ["mentions", "delegated"])
    return out.withColumn("trust_score", F.col("review_requests") + F.col("assignments") + F.col("labels_added") + 2 * F.col("sensitive_labels"))


def treatment_metrics(items: DataFrame, messages: DataFrame, keys: Sequence[str] = ("person",), timeline: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """All five families side by side; columns that two of them share get the family's name in front.

    With a timeline (of pre-core events, as a rule), total_pr_events, total_issue_events and total_commit_events count its
    events, and its people without threads have a row too; with types (keys, project_type), project_type is added,
    "unknown" where there is none.
    """
    on = list(keys)
    timing, breadth = response_timing(items, messages, keys), engagement_breadth(items, messages, keys)
    talk, praise, trust = interaction_patterns(messages, keys), recognition_signals(items, messages, keys).withColumnRenamed("prs", "recognition_prs"), trust_indicators(items, messages, keys)
    out = timing
    for part in (breadth, talk, praise, trust):
        out = out.join(part, on, "left")
    if timeline is not None:
        kinds = (("pull_request", "total_pr_events"), ("issue", "total_issue_events"), ("commit", "total_commit_events"))
        out = timeline.groupBy(*on).agg(*[count_if(F.col("event_type") == k).alias(n) for k, n in kinds]).join(out, on, "left")
    if types is not None:
        known = types.groupBy(*on).agg(F.min("project_type").alias("project_type"))
        out = out.join(known, on, "left").fillna("unknown", ["project_type"])
    return out


def response_summary_simple(items: DataFrame, messages: DataFrame, keys: Sequence[str] = ("person",)) -> DataFrame:
    """keys, threads, merge_rate, close_rate, unique_reviewers, first responses (earliest reply by another, in hours): count,
    mean and the upper median."""
    hours = (F.unix_seconds("replied_at") - F.unix_seconds("created_at")) / 3600.0
    threads = by_others(messages).withColumn("h", hours).where("h >= 0").groupBy(*keys, "thread_id").agg(F.min("h").alias("h"))
    first = threads.groupBy(*keys).agg(F.count(F.lit(1)).alias("answered"), F.avg("h").alias("mean_hours"))
    # The value at place floor(n / 2) from 0: with an even number the upper of the two in the middle.
    upper = threads.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    first = first.join(upper.where(F.col("place") == F.floor(F.col("n") / 2) + 1).select(*keys, F.col("h").alias("upper_median_hours")), list(keys))
    pr = F.col("event_type") == "pull_request"
    n = F.greatest(count_if(pr), F.lit(1))
    base = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("threads"), (count_if(pr & (F.col("state") == "merged")) / n).alias("merge_rate"), (count_if(pr & (F.col("state") == "rejected")) / n).alias("close_rate"))
    who = items.select(*keys, F.explode("reviewers").alias("r")).where("r is not null").groupBy(*keys).agg(F.count_distinct("r").alias("unique_reviewers"))
    return base.join(who, list(keys), "left").join(first, list(keys), "left").fillna(0, ["unique_reviewers", "answered"])


def active_only(metrics: DataFrame, prs: str = "prs", issues: str = "issues") -> DataFrame:
    """People with a pull request or an issue."""
    return metrics.where((F.coalesce(F.col(prs), F.lit(0)) > 0) | (F.coalesce(F.col(issues), F.lit(0)) > 0))


def metric_category_summary(compared: DataFrame, categories: dict[str, str], significant: Column) -> DataFrame:
    """category, metrics, significant ones, and the significant ones by direction (a map). categories: metric -> category,
    a fixed, small map; metrics that aren't listed are "other"."""
    pairs = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    rows = compared.withColumn("category", F.coalesce(pairs[F.col("metric")], F.lit("other"))).withColumn("hit", significant)
    by_direction = rows.where("hit").groupBy("category", "direction").agg(F.count(F.lit(1)).alias("k"))
    maps = by_direction.groupBy("category").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("direction", "k")))).alias("directions"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("metrics"), count_if(F.col("hit")).alias("significant")).join(maps, "category", "left")


def outlier_impact(long: DataFrame, group: str, fence: float = 1.5, min_n: int = 4) -> DataFrame:
    """(metric, group): n, mean, median before and after values outside the quartile fences go; groups with few values or no
    spread are left out. long: metric, group, x."""
    keys = ["metric", group]
    q = long.where("x is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))
    q = on_keys(q, quantiles(long, keys, "x", {"q25": 0.25, "median": 0.5, "q75": 0.75}), keys)
    q = q.where((F.col("n") >= min_n) & (F.col("q75") > F.col("q25")))
    spread = F.col("q75") - F.col("q25")
    kept = long.join(q, keys).where((F.col("x") >= F.col("q25") - fence * spread) & (F.col("x") <= F.col("q75") + fence * spread))
    after = on_keys(kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_clean"), F.avg("x").alias("mean_clean")), quantiles(kept.select(*keys, "x"), keys, "x", {"median_clean": 0.5}), keys)
    return q.join(after, keys).select(*keys, "n", "mean", "median", "n_clean", "mean_clean", "median_clean", (F.col("n") - F.col("n_clean")).alias("outliers"))


def zero_patterns(long: DataFrame, group: str) -> DataFrame:
    """(metric, group): rows, nulls, zeros, participation_rate (values that are neither), mean and median of these,
    and chi2 and p_value of the groups taking part alike (the same for all groups of a metric; null where they can't differ)."""
    x = F.col("x")
    real = F.when(x.isNotNull() & (x != 0), x)
    out = long.groupBy("metric", group).agg(F.count(F.lit(1)).alias("rows"), count_if(x.isNull()).alias("nulls"), count_if(x == 0).alias("zeros"), (F.count(real) / F.count(F.lit(1))).alias("participation_rate"), F.avg(real).alias("nonzero_mean"))
    real_rows = F.col("rows") - F.col("nulls") - F.col("zeros")
    test = chi_square_of_counts(out.select("metric", real_rows.alias("yes"), (F.col("nulls") + F.col("zeros")).alias("no")), "yes", "no", ["metric"]).select("metric", "chi2", "p_value")
    out = on_keys(out, quantiles(long.where(x != 0), ["metric", group], "x", {"nonzero_median": 0.5}), ["metric", group])
    return out.join(test, "metric", "left")
