"""Queries of section 2.7: timelines and treatment metrics. Threads are written as JSON and read back through the normaliser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import stats, threads, treatment
from trailmark.plans.registry import query
from trailmark.plans.sql_tails import chi2_p, yates_sql
from trailmark.plans.views import COMMITS, MESSAGES, REPLIES, TIMELINE, commits, messages, replies, table, timeline

def _json_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as an event whose payload holds its lines as messages, in one of four shapes by its key."""
    r = replies(spark, sf_dir)
    stamp = F.date_format("replied_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    one = F.struct("pos", F.col("author").alias("a"), stamp.alias("t"), F.concat(F.lit("line "), F.col("pos")).alias("b"), F.col("role").alias("r"))
    t = r.groupBy("person", "thread_id", "event_type", "created_at").agg(F.sort_array(F.collect_list(one)).alias("m"))
    node = lambda m: F.struct(F.struct(m["a"].alias("login")).alias("author"), m["t"].alias("createdAt"), m["b"].alias("body"), m["r"].alias("authorAssociation"))
    flat = lambda m: F.struct(m["a"].alias("author"), m["t"].alias("timestamp"), m["b"].alias("body"), m["r"].alias("role"))
    user = lambda m: F.struct(F.struct(m["a"].alias("login")).alias("user"), m["t"].alias("created_at"), m["b"].alias("body"), m["r"].alias("author_association"))
    item = lambda m: F.struct(F.lit("IssueComment").alias("__typename"), F.struct(m["a"].alias("login")).alias("actor"), m["t"].alias("createdAt"), m["b"].alias("body"), m["r"].alias("authorAssociation"))
    k = F.col("thread_id")
    state = F.when(k % 3 == 0, "MERGED").when(k % 3 == 1, "CLOSED").otherwise("OPEN")
    labels = F.when(k % 2 == 0, F.array(F.struct(F.lit("Security fix").alias("name")), F.struct(F.lit("docs").alias("name"))))
    review = F.struct(F.struct(F.concat(F.lit("s"), k % 7).alias("login")).alias("author"), F.when(k % 5 < 3, "APPROVED").otherwise("CHANGES_REQUESTED").alias("state"), F.date_format(F.col("created_at") + F.expr("interval 5 hours"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("submittedAt"))
    payload = F.to_json(
        F.struct(
            F.struct(F.col("person").alias("login")).alias("author"),
            F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"),
            state.alias("state"),
            F.when(k % 4 == 0, F.transform("m", flat)).alias("conversations"),
            F.when(k % 4 == 1, F.to_json(F.struct(F.transform("m", node).alias("nodes")))).alias("x"),
            labels.alias("labels"),
            F.when(k % 3 == 0, F.struct(F.when(k % 2 == 0, F.col("person")).otherwise(F.lit("s1")).alias("login"))).alias("mergedBy"),
            F.struct(F.array_repeat(review, (k % 3).cast("int")).alias("nodes")).alias("reviews"),
            F.array_repeat(F.struct(F.lit("z").alias("login")), (k % 2).cast("int")).alias("assignees"),
            F.when(k % 4 == 1, F.struct(F.transform("m", node).alias("nodes"))).alias("comments"),
            F.when(k % 4 == 3, F.transform("m", item)).alias("timelineEvents"),
        )
    )
    # The plain list of comments shares its name with the nodes, so it is put in as text.
    plain = F.concat(F.expr("left(payload, length(payload) - 1)"), F.lit(',"comments":'), F.to_json(F.transform("m", user)), F.lit("}"))
    t = t.withColumn("payload", payload)
    data = F.when(k % 4 == 2, plain).otherwise(F.col("payload"))
    return t.select("person", k.alias("event_id"), "event_type", F.col("created_at").alias("event_timestamp"), data.alias("event_data"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return threads.thread_tables(_json_timeline(spark, sf_dir))


OTHERS = f"WITH {REPLIES}, others AS (SELECT *, (epoch(replied_at) - epoch(created_at)) / 3600.0 AS hours FROM replies WHERE author <> person)"


@query(f"WITH {REPLIES} SELECT person, thread_id, (row_number() OVER (PARTITION BY thread_id ORDER BY pos, author, replied_at, role) - 1)::INT AS pos, author, replied_at, 'line ' || pos AS body, role FROM replies")
def extract_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.thread_messages(_json_timeline(spark, sf_dir)).select("person", "thread_id", "pos", "author", "replied_at", "body", "role")


@query(f"WITH {REPLIES} SELECT thread_id, any_value(person) AS author, CASE thread_id % 3 WHEN 0 THEN 'merged' WHEN 1 THEN 'rejected' ELSE 'open' END AS state FROM replies GROUP BY 1")
def extract_author_and_pr_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)[0].select("thread_id", F.col("item_author").alias("author"), "state")


@query("""SELECT 0 AS i, 0::INT AS n UNION ALL SELECT 1, 0 UNION ALL SELECT 2, 0 UNION ALL SELECT 3, 1 UNION ALL SELECT o_orderkey + 10, 1 FROM orders""")
def broken_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.createDataFrame([(0, ""), (1, None), (2, '{"comments": [}'), (3, '{"timelineEvents":[{"__typename":"PullRequestReview","body":"x"},{"__typename":"LabeledEvent"}]}')], "i bigint, j string")
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 10).alias("i"), F.concat(F.lit('{"comments":[{"user":{"login":"u'), F.col("o_custkey"), F.lit('"},"body":"b"}]}')).alias("j"))
    return odd.unionByName(rows).select("i", F.coalesce(F.size(threads.extract_conversations(threads.parsed(F.col("j")))), F.lit(0)).alias("n"))


@query(f"""WITH {COMMITS}, pairs AS (SELECT DISTINCT project_name, upper(author_email) AS author_email, author_email AS k FROM commits WHERE commit_hash::BIGINT % 2 = 0 UNION SELECT 'NATION_0', 'nobody', 'nobody' UNION SELECT 'none', 'nobody', 'nobody')
SELECT p.project_name, p.author_email, coalesce(o.t, a.t, 'UNKNOWN') AS project_type FROM pairs p LEFT JOIN (SELECT project_name, author_email, min(project_type) AS t FROM commits GROUP BY 1, 2) o ON o.project_name = p.project_name AND o.author_email = p.k
LEFT JOIN (SELECT project_name, min(project_type) AS t FROM commits GROUP BY 1) a ON a.project_name = p.project_name""")
def project_type_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = commits(spark, sf_dir)
    pairs = c.where("cast(commit_hash as bigint) % 2 = 0").select("project_name", F.upper("author_email").alias("author_email")).distinct()
    return threads.project_type_lookup(pairs.unionByName(spark.createDataFrame([("NATION_0", "nobody"), ("none", "nobody")], pairs.schema)), c)


@query(f"""WITH {COMMITS}, firsts AS (SELECT project_name, author_email, min(commit_date) AS fc, quantile_disc(commit_date, 0.5) AS core FROM commits GROUP BY 1, 2),
ev AS (SELECT project_name, author_email, 'commit' AS event_type, commit_date AS ts, commit_hash AS id FROM commits UNION ALL SELECT project_name, author_email, 'issue', commit_date + INTERVAL 3 HOUR, 'i' || commit_hash FROM commits WHERE commit_hash::BIGINT % 3 = 0)
SELECT project_name, author_email, event_type, ts AS event_timestamp, id AS event_identifier, floor(date_diff('day', fc::DATE, ts::DATE) / 7)::INT AS event_week, ts < core AS is_pre_core, (row_number() OVER (PARTITION BY project_name, author_email ORDER BY ts, id, event_type) - 1)::INT AS event_id FROM ev JOIN firsts USING (project_name, author_email)""")
def build_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = commits(spark, sf_dir)
    core = c.groupBy("project_name", F.upper("author_email").alias("author_email")).agg(F.sort_array(F.collect_list("commit_date")).alias("d"))
    core = core.select("project_name", "author_email", F.element_at("d", F.ceil(F.size("d") / 2).cast("int")).alias("first_core_date"))
    ev = c.where("cast(commit_hash as bigint) % 3 = 0").select("project_name", "author_email", F.lit("issue").alias("event_type"), (F.col("commit_date") + F.expr("interval 3 hours")).alias("event_timestamp"), F.concat(F.lit("i"), F.col("commit_hash")).alias("event_identifier"), F.lit("{}").alias("event_data"))
    return threads.build_timeline(ev, c, core).drop("event_data")


ITEMS = f"""WITH {REPLIES}, items AS (SELECT person, thread_id, any_value(event_type) AS event_type, any_value(created_at) AS created_at, count(*) AS n_messages, CASE thread_id % 3 WHEN 0 THEN 'merged' WHEN 1 THEN 'rejected' ELSE 'open' END AS state, (thread_id % 3)::BIGINT AS n_reviews,
  CASE WHEN thread_id % 2 = 0 THEN 2 ELSE 0 END AS n_labels, (thread_id % 2)::BIGINT AS n_assignees, 's' || (thread_id % 7) AS reviewer, event_type = 'pull_request' AS pr FROM replies GROUP BY ALL)"""


@query(f"""{ITEMS}, c AS (SELECT person, count(*) FILTER (pr) AS prs, count(*) FILTER (NOT pr) AS issues, coalesce(sum(n_messages + n_reviews) FILTER (pr), 0)::BIGINT AS pr_comments, coalesce(sum(n_messages) FILTER (NOT pr), 0)::BIGINT AS issue_comments FROM items GROUP BY 1)
SELECT *, round(CASE WHEN prs > 0 THEN pr_comments / prs ELSE 0 END, 6) AS avg_pr_comments, round(CASE WHEN issues > 0 THEN issue_comments / issues ELSE 0 END, 6) AS avg_issue_comments FROM c""")
def comment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.comment_counts(_tables(spark, sf_dir)[0])


@query(f"""{OTHERS}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY pos, author, replied_at, role) = 1 AS is_first FROM others WHERE hours >= 0), p AS (SELECT DISTINCT person FROM replies),
t AS (SELECT person, count(*) AS responses, count(*) FILTER (is_first) AS first_count, avg(hours) FILTER (is_first) AS fm, quantile_cont(hours, 0.5) FILTER (is_first) AS fmed, stddev_pop(hours) FILTER (is_first) AS fs, min(hours) FILTER (is_first) AS fmin, max(hours) FILTER (is_first) AS fmax, quantile_cont(hours, 0.25) FILTER (is_first) AS q25, quantile_cont(hours, 0.75) FILTER (is_first) AS q75,
  avg(hours) AS am, quantile_cont(hours, 0.5) AS amed, stddev_pop(hours) AS asd, avg(CASE WHEN isodow(replied_at) >= 6 THEN 1.0 ELSE 0 END) AS we, avg(CASE WHEN hours <= 24 THEN 1.0 ELSE 0 END) AS sd FROM r GROUP BY 1), n AS (SELECT person, count(DISTINCT thread_id) AS items FROM replies GROUP BY 1)
SELECT person, items, items AS items_with_responses, 1.0::DOUBLE AS response_rate, coalesce(responses, 0) AS responses, coalesce(first_count, 0) AS first_count, round(fm, 6) AS first_mean, round(fmed, 6) AS first_median, round(fs, 6) AS first_std, fmin AS first_min, fmax AS first_max, round(q25, 6) AS first_q25, round(q75, 6) AS first_q75,
  round(am, 6) AS all_mean, round(amed, 6) AS all_median, round(asd, 6) AS all_std, round(coalesce(we, 0), 6) AS weekend_rate, round(coalesce(sd, 0), 6) AS same_day_rate FROM n LEFT JOIN t USING (person)""")
def response_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, said = threads.thread_tables(_json_timeline(spark, sf_dir), only=("n_messages", "author", "replied_at"))
    return treatment.response_timing(items, said).drop("off_hours_rate", "business_hours_rate", "within_hour_rate")


@query(f"""{ITEMS}, said AS (SELECT person, thread_id, event_type, author, role FROM replies WHERE author <> person UNION ALL SELECT person, thread_id, event_type, reviewer, NULL FROM items, range(n_reviews::BIGINT) WHERE pr AND reviewer <> person),
each AS (SELECT person, author, count(*) AS n, count(DISTINCT thread_id) FILTER (event_type = 'pull_request') AS prs, count(*) FILTER (role IS NULL OR role = 'MEMBER') AS m, count(*) FILTER (role = 'CONTRIBUTOR') AS pe FROM said GROUP BY 1, 2),
f AS (SELECT person, count(*) AS unique_responders, sum(n)::BIGINT AS breadth_responses, count(*) FILTER (prs > 0) AS unique_pr_responders, sum(m) / sum(n) AS maintainer_rate, sum(pe) / sum(n) AS peer_rate, count(*) FILTER (prs > 1) AS repeat_engagers, coalesce(avg(prs) FILTER (prs > 0), 0) AS avg_prs_per_responder, max(prs) AS max_prs_per_responder, 1 - sum(n * n) / (sum(n) * sum(n)) AS diversity, max(n) / sum(n) AS top_share FROM each GROUP BY 1)
SELECT person, coalesce(unique_responders, 0) AS unique_responders, coalesce(breadth_responses, 0) AS breadth_responses, coalesce(unique_pr_responders, 0) AS unique_pr_responders, round(coalesce(maintainer_rate, 0), 6) AS maintainer_rate, round(coalesce(peer_rate, 0), 6) AS peer_rate, coalesce(repeat_engagers, 0) AS repeat_engagers, round(coalesce(avg_prs_per_responder, 0), 6) AS avg_prs_per_responder,
  coalesce(max_prs_per_responder, 0) AS max_prs_per_responder, round(coalesce(diversity, 0), 6) AS diversity, round(coalesce(top_share, 0), 6) AS top_share FROM (SELECT DISTINCT person FROM items) LEFT JOIN f USING (person)""")
def engagement_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treatment.engagement_breadth(*_tables(spark, sf_dir)).drop("unique_roles", "role_diversity", "external_rate")


TALK = f"""WITH {MESSAGES}, m AS (SELECT *, len(list_filter(string_split_regex(body, '\\s+'), lambda x: x <> '')) AS w, greatest(1, len(body) - len(replace(replace(replace(body, '.', ''), '!', ''), '?', ''))) AS s FROM messages WHERE body <> '')"""


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.timestamp_seconds(F.lit(0))
    return messages(spark, sf_dir).withColumn("item_author", F.lit("user")).withColumn("event_type", F.lit("issue")).withColumn("created_at", now).withColumn("replied_at", now).withColumn("role", F.lit("NONE"))


@query(f"""{TALK}, th AS (SELECT person, thread_id, count(*) AS length, count(*) FILTER (author <> coalesce(prev, 'user')) AS turns FROM (SELECT *, lag(author) OVER (PARTITION BY person, thread_id ORDER BY pos) AS prev FROM messages) GROUP BY 1, 2),
a AS (SELECT person, round(avg(length), 6) AS length_mean, quantile_cont(length, 0.5) AS length_median, max(length) AS length_max, round(avg(turns), 6) AS turns_mean, max(turns) AS turns_max FROM th GROUP BY 1),
b AS (SELECT person, count(*) AS messages, round(avg(w), 6) AS words_mean, quantile_cont(w, 0.5) AS words_median, max(w)::INT AS words_max, round(avg(s), 6) AS sentences_mean, round(avg(CASE WHEN contains(body, '?') THEN 1.0 ELSE 0 END), 6) AS question_rate, round(avg(CASE WHEN contains(body, 'http://') OR contains(body, 'https://') THEN 1.0 ELSE 0 END), 6) AS link_rate, round(avg(CASE WHEN contains(body, '`') THEN 1.0 ELSE 0 END), 6) AS code_rate FROM m GROUP BY 1)
SELECT * FROM a LEFT JOIN b USING (person)""")
def interaction_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treatment.interaction_patterns(_talk(spark, sf_dir)).select("person", "length_mean", "length_median", "length_max", "turns_mean", "turns_max", "messages", "words_mean", "words_median", "words_max", "sentences_mean", "question_rate", "link_rate", "code_rate")


@query(f"""WITH {MESSAGES}, m AS (SELECT * FROM messages WHERE body <> '' AND author <> 'user')
SELECT person, count(*) AS recognition_messages, round(avg(CASE WHEN regexp_matches(body, '\\b(thank|thanks|thx|appreciate|grateful|kudos)\\b', 'i') THEN 1.0 ELSE 0 END), 6) AS thanks_rate, round(avg(CASE WHEN regexp_matches(body, '\\b(love|like|good|nice|helpful|useful|clear|clean|solid)\\b', 'i') THEN 1.0 ELSE 0 END), 6) AS positive_rate FROM m GROUP BY 1""")
def recognition_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = _talk(spark, sf_dir)
    items = talk.select("person", "thread_id", "event_type", "item_author", F.lit("open").alias("state"), F.lit(None).cast("string").alias("merged_by"), F.lit(0).alias("n_approvals"), F.lit(0).alias("n_rejections"), F.array().cast("array<double>").alias("approval_hours")).distinct()
    return treatment.recognition_signals(items, talk).where("recognition_messages > 0").select("person", "recognition_messages", "thanks_rate", "positive_rate")


@query(f"""{ITEMS} SELECT person, count(*) FILTER (pr) AS prs, round(count(*) FILTER (pr AND state = 'merged') / greatest(count(*) FILTER (pr), 1), 6) AS merge_rate, round(count(*) FILTER (pr AND state = 'rejected') / greatest(count(*) FILTER (pr), 1), 6) AS close_rate,
  round(coalesce(sum(CASE WHEN thread_id % 5 < 3 THEN n_reviews ELSE 0 END) FILTER (pr), 0) / greatest(count(*) FILTER (pr), 1), 6) AS approval_rate, round(coalesce(sum(CASE WHEN thread_id % 5 >= 3 THEN n_reviews ELSE 0 END) FILTER (pr), 0) / greatest(count(*) FILTER (pr), 1), 6) AS rejection_rate,
  round(count(*) FILTER (pr AND thread_id % 3 = 0 AND thread_id % 2 = 1) / greatest(count(*) FILTER (pr AND thread_id % 3 = 0), 1), 6) AS attribution_rate, CASE WHEN count(*) FILTER (pr AND thread_id % 5 < 3 AND n_reviews > 0) > 0 THEN 5.0::DOUBLE END AS approval_mean FROM items GROUP BY 1""")
def recognition_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treatment.recognition_signals(*_tables(spark, sf_dir)).select("person", "prs", "merge_rate", "close_rate", "approval_rate", "rejection_rate", "attribution_rate", "approval_mean")


@query(f"""{ITEMS} SELECT person, sum(n_labels)::BIGINT AS labels_added, count(*) FILTER (pr AND n_labels > 0) AS sensitive_labels, coalesce(sum(n_assignees) FILTER (NOT pr), 0)::BIGINT AS assignments, coalesce(sum(greatest(n_reviews - 1, 0)) FILTER (pr), 0)::BIGINT AS re_engagements,
  round(count(*) FILTER (pr AND n_reviews > 1) / greatest(count(*) FILTER (pr), 1), 6) AS re_engagement_rate, round(count(*) FILTER (pr AND n_labels > 0) / greatest(count(*) FILTER (pr), 1), 6) AS label_rate, round(count(*) FILTER (NOT pr AND n_assignees > 0) / greatest(count(*) FILTER (NOT pr), 1), 6) AS assignment_rate,
  count(*) FILTER (pr AND state = 'merged') AS administrative_actions, (coalesce(sum(n_assignees) FILTER (NOT pr), 0) + sum(n_labels) + 2 * count(*) FILTER (pr AND n_labels > 0))::BIGINT AS trust_score FROM items GROUP BY 1""")
def trust_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treatment.trust_indicators(*_tables(spark, sf_dir)).select("person", "labels_added", "sensitive_labels", "assignments", "re_engagements", "re_engagement_rate", "label_rate", "assignment_rate", "administrative_actions", "trust_score")


@query(f"""{OTHERS}, h AS (SELECT person, thread_id, min(hours) AS h FROM others WHERE hours >= 0 GROUP BY 1, 2) SELECT person, count(*) AS answered, round(avg(h), 6) AS mean_hours, round(list_sort(list(h))[(count(*) // 2 + 1)::BIGINT], 6) AS upper_median_hours FROM h GROUP BY 1""")
def response_summary_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treatment.response_summary_simple(*_tables(spark, sf_dir)).where("answered > 0").select("person", "answered", "mean_hours", "upper_median_hours")


@query(f"""{ITEMS}, ev AS (SELECT DISTINCT person, thread_id, event_type FROM items UNION ALL SELECT 'c' || o_custkey, o_orderkey, 'commit' FROM orders WHERE o_orderkey % 4 = 0),
n AS (SELECT person, count(*) FILTER (event_type = 'pull_request') AS total_pr_events, count(*) FILTER (event_type = 'issue') AS total_issue_events, count(*) FILTER (event_type = 'commit') AS total_commit_events FROM ev GROUP BY 1),
t AS (SELECT person, count(*) FILTER (pr) AS recognition_prs FROM items GROUP BY 1)
SELECT person, CASE WHEN substr(person, 2)::BIGINT % 5 = 0 THEN 'unknown' WHEN substr(person, 2)::BIGINT % 3 = 0 THEN 'A' ELSE 'B' END AS project_type, total_pr_events, total_issue_events, total_commit_events, recognition_prs FROM n LEFT JOIN t USING (person) WHERE total_pr_events > 0 OR total_issue_events > 0""")
def treatment_metrics_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide row of people with threads, its counts and metadata; the families' own columns are in their queries."""
    items, said = _tables(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("person"), F.col("o_orderkey").alias("event_id"), "o_custkey")
    commits_too = orders.where("event_id % 4 = 0").select("person", F.lit("commit").alias("event_type"))
    types = orders.where("o_custkey % 5 <> 0").select("person", F.when(F.col("o_custkey") % 3 == 0, "A").otherwise("B").alias("project_type"))
    wide = treatment.treatment_metrics(items, said, timeline=items.select("person", "event_type").unionByName(commits_too), types=types)
    return treatment.active_only(wide, "total_pr_events", "total_issue_events").select("person", "project_type", "total_pr_events", "total_issue_events", "total_commit_events", "recognition_prs")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = threads.timeline_summary(timeline(spark, sf_dir), ["person", "project_type"])
    return stats.unpivot_metrics(s, ["person", "project_type"], ["n_commit", "n_issue", "n_pull_request"])


SUMMARY = f"""WITH {TIMELINE}, s AS (SELECT person, project_type, count(*) AS events, count(*) FILTER (event_type = 'commit') AS n_commit, count(*) FILTER (event_type = 'issue') AS n_issue, count(*) FILTER (event_type = 'pull_request') AS n_pull_request,
  min(event_timestamp) AS first_event, max(event_timestamp) AS last_event, (date_diff('day', min(event_timestamp)::DATE, max(event_timestamp)::DATE) // 7)::INT AS weeks_span, count(*) FILTER (event_id % 5 > 0) AS pre_core_events, count(*) FILTER (event_id % 5 = 0) AS post_core_events FROM timeline GROUP BY 1, 2),
long AS (SELECT person, project_type, metric, x::DOUBLE AS x FROM (UNPIVOT (SELECT person, project_type, n_commit, n_issue, n_pull_request FROM s) ON n_commit, n_issue, n_pull_request INTO NAME metric VALUE x))"""


@query(f"{SUMMARY} SELECT * FROM s")
def timeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.timeline_summary(timeline(spark, sf_dir).withColumn("is_pre_core", F.col("event_id") % 5 > 0), ["person", "project_type"])


@query(f"""{SUMMARY}, q AS (SELECT metric, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b, avg(x) AS m, stddev_pop(x) AS sd FROM long GROUP BY 1)
SELECT person, project_type, string_agg(metric, ',' ORDER BY metric) AS outlier_metrics FROM long JOIN q USING (metric) WHERE x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a) OR (sd > 0 AND abs(x - m) / sd > 3) GROUP BY 1, 2""")
def timeline_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = threads.timeline_summary(timeline(spark, sf_dir), ["person", "project_type"])
    return threads.timeline_outliers(s, ["n_commit", "n_issue", "n_pull_request"], ["person", "project_type"]).withColumn("outlier_metrics", F.array_join("outlier_metrics", ","))


@query(f"""{SUMMARY}, q AS (SELECT metric, project_type, count(*) AS n, avg(x) AS mean, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS b FROM long GROUP BY 1, 2 HAVING count(*) >= 4 AND b > a)
SELECT metric, project_type, any_value(n) AS n, round(any_value(mean), 6) AS mean, any_value(median) AS median, count(*) AS n_clean, round(avg(x), 6) AS mean_clean, quantile_cont(x, 0.5) AS median_clean, any_value(n) - count(*) AS outliers FROM long JOIN q USING (metric, project_type) WHERE x BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) GROUP BY 1, 2""")
def outlier_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treatment.outlier_impact(_long(spark, sf_dir), "project_type")


@query(f"""{SUMMARY}, z AS (SELECT metric, project_type, CASE WHEN x % 3 = 0 THEN 0.0 WHEN x % 3 = 1 THEN NULL ELSE x END AS x FROM long),
zp AS (SELECT metric, project_type, count(*) AS rows, count(*) FILTER (x IS NULL) AS nulls, count(*) FILTER (x = 0) AS zeros, round(count(*) FILTER (x <> 0) / count(*), 6) AS participation_rate, round(avg(x) FILTER (x <> 0), 6) AS nonzero_mean, quantile_cont(x, 0.5) FILTER (x <> 0) AS nonzero_median FROM z GROUP BY 1, 2),
{yates_sql('zp', 'rows - nulls - zeros', 'nulls + zeros', 'metric')} SELECT zp.*, round(chi2, 6) AS chi2, round({chi2_p('chi2')}, 6) AS p_value FROM zp LEFT JOIN yates USING (metric)""")
def zero_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("x") % 3 == 0, 0.0).when(F.col("x") % 3 == 2, F.col("x"))
    return treatment.zero_patterns(_long(spark, sf_dir).withColumn("x", x), "project_type")


@query(f"""{SUMMARY}, m AS (SELECT metric, median(x) FILTER (project_type = 'A') AS a, median(x) FILTER (project_type = 'B') AS b FROM long GROUP BY 1)
SELECT CASE WHEN metric = 'n_commit' THEN 'code' ELSE 'other' END AS category, count(*) AS metrics, count(*) FILTER (a <> b) AS significant,
  nullif(concat_ws(',', CASE WHEN count(*) FILTER (a > b) > 0 THEN 'A=' || count(*) FILTER (a > b) END, CASE WHEN count(*) FILTER (a < b) > 0 THEN 'B=' || count(*) FILTER (a < b) END), '') AS directions FROM m GROUP BY 1""")
def metric_category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = stats.group_compare(_long(spark, sf_dir), "project_type", "A", "B")
    return treatment.metric_category_summary(compared, {"n_commit": "code"}, F.col("median1") != F.col("median2")).withColumn("directions", F.array_join(F.transform(F.map_entries("directions"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))
