"""Queries of sections 2.2, 2.3 and 2.10: projects, core membership, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import columns as C
from trailmark.operators import core, projects, stats
from trailmark.plans.registry import query
from trailmark.plans.sql_tails import chi2_p, normal_p, yates_sql
from trailmark.plans.views import COMMITS, WIDE, commits, table, wide_authors

COUNTS = f"""WITH {COMMITS}, counts AS (SELECT project_name, author_email, count(*) AS n FROM commits GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY project_name) AS total,
  sum(n) OVER (PARTITION BY project_name ORDER BY n DESC, author_email ROWS UNBOUNDED PRECEDING) AS cum FROM counts)"""


# 2.2 cleaning, keys, project tables


@query(f"WITH {COMMITS} SELECT commit_hash, lower(trim(author_email)) AS author_email, project_name || '::' || lower(trim(author_email)) || '::' || trim(author_name) AS contributor_id FROM commits")
def normalize_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = commits(spark, sf_dir).withColumn("author_email", F.concat(F.lit("  "), F.upper("author_email"), F.lit(" ")))
    return projects.normalize_identity(raw).select("commit_hash", "author_email", "contributor_id")


@query("SELECT event_id, ts::TIMESTAMP AS ts FROM events")
def normalize_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("string").alias("ts"))
    broken = raw.limit(1).withColumn("ts", F.lit("no time"))
    return projects.normalize_timestamps(raw.unionByName(broken), "ts")


@query("SELECT event_id, date_trunc('week', ts)::DATE AS week_date, strftime(ts, '%Y-%m') AS month, year(ts)::INT AS year FROM events")
def week_and_month_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", C.week_start(F.col("ts")).alias("week_date"), C.month_of(F.col("ts")).alias("month"), F.year("ts").alias("year"))


@query("""SELECT event_id, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS weekday, isodow(ts) >= 6 AS weekend,
  CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS part FROM events""")
def calendar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", F.hour(ts).alias("hour"), F.weekday(ts).alias("weekday"), C.is_weekend(ts).alias("weekend"), C.day_part(ts).alias("part"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'user' || c_custkey END AS login FROM customer")
def username_from_noreply(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    mail = F.when(key % 3 == 0, F.concat(F.lit("12+User"), key, F.lit("@users.noreply.github.com"))).when(key % 3 == 1, F.concat(F.lit("user"), key, F.lit("@users.noreply.github.com"))).otherwise(F.concat(F.lit("user"), key, F.lit("@example.org")))
    return table(spark, sf_dir, "customer").select("c_custkey", C.noreply_login(mail).alias("login"))


@query(f"""WITH {COMMITS}, sample AS (SELECT project_name, author_email, min(commit_hash) AS commit_hash FROM commits WHERE total_insertions % 2 = 0 GROUP BY ALL),
pairs AS (SELECT DISTINCT project_name, author_email FROM commits)
SELECT project_name, author_email, s.commit_hash, c.author_name, CASE WHEN s.commit_hash IS NOT NULL THEN 'hash' ELSE 'email' END AS source
FROM pairs JOIN (SELECT author_email, min(author_name) AS author_name FROM commits GROUP BY 1) c USING (author_email) LEFT JOIN sample s USING (project_name, author_email)""")
def first_nonempty_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = commits(spark, sf_dir)
    return projects.identity_lookup(c.select("project_name", "author_email").distinct(), c.where("total_insertions % 2 = 0").select("project_name", "author_email", "commit_hash"), c)


@query(f"""WITH {COMMITS} SELECT project_type, count(*) AS commits, count(*) FILTER (author_email LIKE '%7') AS bot_commits,
  round(count(*) FILTER (author_email LIKE '%7') * 100.0 / count(*), 6) AS bot_pct, count(*) FILTER (commit_hash LIKE '%3') AS bot_messages FROM commits GROUP BY 1""")
def bot_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = commits(spark, sf_dir)
    c = c.withColumn("author_name", F.when(F.col("author_email").endswith("7"), F.concat("author_name", F.lit("[Bot]"))).otherwise(F.col("author_name")))
    return projects.bot_shares(c.withColumn("message", F.when(F.col("commit_hash").endswith("3"), "Robot update").otherwise("x")), message="message")


#: Owners with their class by the surveyed rule, worked out by hand.
OWNERS = {
    "docker": "company-backed", "GitHub": "company-backed", "stripe": "company-backed", " linkedin ": "company-backed", "tensorflow": "company-backed", "googleapis": "company-backed", "x": "company-backed",
    "amazon": "community-led", "vmware": "community-led", "Apache": "community-led", "openjs-foundation": "community-led", "MyFoundationWorks": "community-led", "qt": "community-led", "my-project": "community-led", "someone": "community-led",
    "": "unknown", "   ": "unknown",
}


@query(f"""SELECT CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS project_type,
  CASE p_partkey % {len(OWNERS)} {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(OWNERS.values()))} END AS owner_class, count(*) AS projects FROM part GROUP BY ALL""")
def classify_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.array(*[F.lit(o) for o in OWNERS])[(F.col("p_partkey") % len(OWNERS)).cast("int")]
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, "A").otherwise("B").alias("project_type"), F.concat_ws("/", owner, F.col("p_partkey").cast("string")).alias("project_name"))
    return projects.owner_class_counts(p)


@query(f"""WITH {COMMITS}, facts AS (SELECT project_name, count(DISTINCT author_email) AS contributors, count(*) AS commits, sum(total_deletions)::BIGINT AS closed_prs,
  date_diff('day', min(commit_date)::DATE, max(commit_date)::DATE)::INT AS age_days, 100 + len(project_name) * 20 AS idle_days FROM commits GROUP BY 1)
SELECT project_name, contributors, commits, contributors >= 10 AS enough_contributors, commits >= 500 AS enough_commits, closed_prs >= 50 AS enough_closed_prs,
  age_days >= 365 AS old_enough, idle_days <= 365 AS recently_updated, contributors >= 10 AND commits >= 500 AND closed_prs >= 50 AND age_days >= 365 AND idle_days <= 365 AS meets_criteria FROM facts""")
def project_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = commits(spark, sf_dir).groupBy("project_name").agg(F.count_distinct("author_email").alias("contributors"), F.count(F.lit(1)).alias("commits"), F.sum("total_deletions").alias("closed_prs"), F.datediff(F.max("commit_date"), F.min("commit_date")).alias("age_days"))
    facts = facts.withColumn("idle_days", 100 + F.length("project_name") * 20)
    return projects.project_eligibility(facts).drop("closed_prs", "age_days", "idle_days")


@query("""WITH u AS (SELECT 'n' || n_nationkey AS project_name, 'nations' AS list_source FROM nation UNION ALL SELECT 'r' || r_regionkey, 'regions' FROM region)
SELECT * FROM u WHERE project_name NOT IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1)""")
def project_list_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    name = F.concat(F.lit("n"), F.col("n_nationkey")).alias("project_name")
    failed = n.where("n_regionkey = 1").select(name)
    return projects.project_list_union([("nations", n.select(name)), ("regions", r.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("project_name")))], failed=failed)


@query(f"""WITH {COMMITS} SELECT project_name, project_type, count(DISTINCT author_email) AS authors, count(*) AS commits, min(commit_date) AS first_commit, max(commit_date) AS last_commit,
  round(date_diff('day', min(commit_date)::DATE, max(commit_date)::DATE) / 365.25, 6) AS age_years FROM commits GROUP BY 1, 2""")
def ecosystem_comparability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.ecosystem_facts(commits(spark, sf_dir))


@query(f"""WITH {WIDE}, each AS (SELECT author_email, bool_or(project_type = 'A') AS a, bool_or(project_type = 'B') AS b FROM wide WHERE commit_date < '1998-01-20' AND project_name < 'Brand#3' GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (a) AS in_first, count(*) FILTER (b) AS in_second, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (b AND NOT a) AS only_second FROM each""")
def contributors_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.contributors_by_group(wide_authors(spark, sf_dir).where("commit_date < '1998-01-20' and project_name < 'Brand#3'"), "A", "B")


@query(f"""WITH {WIDE} SELECT (SELECT count(DISTINCT author_email) FROM wide) AS emails, (SELECT max(k) FROM (SELECT count(DISTINCT author_name) AS k FROM wide GROUP BY author_email)) AS max_names_per_email,
  (SELECT count(DISTINCT author_name) FROM wide) AS names, (SELECT max(k) FROM (SELECT count(DISTINCT author_email) AS k FROM wide GROUP BY author_name)) AS max_emails_per_name,
  round((SELECT avg(CASE WHEN c IN (SELECT author_name FROM wide) THEN 1.0 ELSE 0.0 END) FROM (SELECT DISTINCT 'n' || (c_custkey % 60) AS c FROM customer)), 6) AS matched_rate""")
def names_per_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_custkey") % 60).alias("author_name"))
    return projects.names_per_email(wide_authors(spark, sf_dir), names)


# 2.3 core membership


@query(f"{COUNTS} SELECT project_name, author_email, n FROM ranked WHERE (cum - n) * 100 < total * 80")
def core_rule_80(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.core_members(core.contributor_counts(commits(spark, sf_dir)))


@query(f"{COUNTS} SELECT project_name, author_email, n FROM ranked WHERE (cum - n) * 100 <= total * 80")
def core_rule_80_strict_plus_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.core_members(core.contributor_counts(commits(spark, sf_dir)), rule="plus_one")


@query(f"""{COUNTS}, least AS (SELECT project_name, coalesce(min(n) FILTER (cum * 100 <= total * 80), max(n)) AS least FROM ranked GROUP BY 1)
SELECT project_name, author_email, n FROM ranked JOIN least USING (project_name) WHERE n >= least""")
def core_rule_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.core_members(core.contributor_counts(commits(spark, sf_dir)), rule="ties")


@query(f"""{COUNTS}, p AS (SELECT unnest([50, 80, 90]) AS percent)
SELECT project_name, percent, count(*) AS core_size, sum(n)::BIGINT AS core_commits, any_value(total)::BIGINT AS total, round(sum(n) / any_value(total), 6) AS coverage, (any_value(total)::BIGINT * percent // 100)::BIGINT AS threshold
FROM ranked, p WHERE (cum - n) * 100 < total * percent GROUP BY project_name, percent""")
def core_percentile_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, out = core.contributor_counts(commits(spark, sf_dir)), None
    for percent in (50, 80, 90):
        one = core.core_summary(counts, percent=percent).withColumn("percent", F.lit(percent)).drop("contributors")
        out = one if out is None else out.unionByName(one)
    return out


CONCENTRATION = f"""{COUNTS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY project_name ORDER BY n, author_email) AS i FROM ranked)
SELECT project_name, round(2.0 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini, least(count(*) FILTER (cum * 2 <= total) + 1, count(*)) AS bus_factor,
  count(*) FILTER (n = 1) AS one_time, round(count(*) FILTER (n = 1) / count(*), 6) AS one_time_ratio, count(*) FILTER (n BETWEEN 2 AND 10) AS casual,
  count(*) FILTER (n BETWEEN 11 AND 100) AS regular, count(*) FILTER (n > 100) AS heavy FROM numbered GROUP BY 1"""


@query(CONCENTRATION)
def gini_bus_factor_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.concentration(core.contributor_counts(commits(spark, sf_dir)))


@query(f"""WITH {COMMITS}, each AS (SELECT project_name, author_email, max(commit_date) AS last FROM commits GROUP BY ALL), ends AS (SELECT project_name, max(last) AS stop FROM each GROUP BY 1)
SELECT project_name, count(*) FILTER (last > stop - INTERVAL 90 DAY) AS active, round(count(*) FILTER (last > stop - INTERVAL 90 DAY) / count(*), 6) AS active_ratio FROM each JOIN ends USING (project_name) GROUP BY 1""")
def active_last_90d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.active_recently(commits(spark, sf_dir))


@query(f"""{COUNTS}, core AS (SELECT project_name, count(*) AS core_size, sum(n)::BIGINT AS core_commits, any_value(total)::BIGINT AS total FROM ranked WHERE (cum - n) * 100 < total * 80 GROUP BY 1),
people AS (SELECT project_name, count(*) AS contributors, least(count(*) FILTER (cum * 2 <= total) + 1, count(*)) AS bus_factor, count(*) FILTER (n = 1) AS one_time FROM ranked GROUP BY 1),
span AS (SELECT project_name, project_type, min(commit_date) AS first_commit, max(commit_date) AS last_commit FROM commits GROUP BY 1, 2)
SELECT project_name, project_type, core_size, core_commits, total, contributors, bus_factor, one_time, round(core_commits / total, 6) AS coverage, round(core_size / contributors, 6) AS core_ratio, first_commit, last_commit
FROM core JOIN people USING (project_name) JOIN span USING (project_name) WHERE total >= 10 AND contributors >= 3""")
def project_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.project_metrics(commits(spark, sf_dir)).select("project_name", "project_type", "core_size", "core_commits", "total", "contributors", "bus_factor", "one_time", "coverage", "core_ratio", "first_commit", "last_commit")


TIMELINE = f"""WITH {COMMITS}, spans AS (SELECT project_name, date_trunc('week', min(commit_date))::DATE AS start, date_trunc('week', max(commit_date))::DATE AS stop FROM commits GROUP BY 1),
weeks AS (SELECT project_name, start, unnest(generate_series(start, stop, INTERVAL 7 DAY))::DATE AS week_date FROM spans),
counts AS (SELECT w.project_name, w.start, w.week_date, c.author_email, count(*) AS n FROM weeks w JOIN commits c ON c.project_name = w.project_name AND c.commit_date < w.week_date + INTERVAL 7 DAY GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY project_name, week_date) AS total, count(*) OVER (PARTITION BY project_name, week_date) AS people,
  sum(n) OVER (PARTITION BY project_name, week_date ORDER BY n DESC, author_email ROWS UNBOUNDED PRECEDING) AS cum FROM counts)"""


@query(f"""{TIMELINE} SELECT project_name, (date_diff('day', any_value(start), week_date) // 7 + 1)::INT AS week_number, week_date, any_value(total)::BIGINT AS commits_to_date, any_value(people) AS contributors_to_date,
  string_agg(author_email, ',' ORDER BY author_email) AS core, count(*) AS core_size, min(n) AS core_min_commits FROM ranked WHERE (cum - n) * 100 < total * 80 GROUP BY project_name, week_date""")
def core_timeline_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.core_timeline_weekly(commits(spark, sf_dir)).withColumn("core", F.array_join("core", ","))


MONTHLY = f"""WITH {COMMITS}, months AS (SELECT project_name, project_type, strftime(commit_date, '%Y-%m') AS month, count(*) AS commits_this_month FROM commits GROUP BY ALL),
indexed AS (SELECT *, row_number() OVER (PARTITION BY project_name ORDER BY month) - 1 AS month_index, sum(commits_this_month) OVER (PARTITION BY project_name ORDER BY month)::BIGINT AS commits_to_date,
  count(*) OVER (PARTITION BY project_name) AS k, sum(commits_this_month) OVER (PARTITION BY project_name) AS total FROM months),
chosen AS (SELECT * FROM indexed WHERE k >= 12 AND total >= 50),
counts AS (SELECT m.project_name, m.month_index, c.author_email, count(*) AS n FROM chosen m JOIN commits c ON c.project_name = m.project_name AND strftime(c.commit_date, '%Y-%m') <= m.month GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY project_name, month_index) AS t, sum(n) OVER (PARTITION BY project_name, month_index ORDER BY n DESC, author_email ROWS UNBOUNDED PRECEDING) AS cum FROM counts),
core AS (SELECT project_name, month_index, author_email, min(month_index) OVER (PARTITION BY project_name, author_email) AS first_index FROM ranked WHERE (cum - n) * 100 < t * 80),
grouped AS (SELECT m.project_name, m.project_type, m.month, m.month_index, m.commits_this_month, m.commits_to_date,
    CASE WHEN m.commits_to_date >= 3 THEN coalesce(list(author_email) FILTER (author_email IS NOT NULL), []) ELSE [] END AS core, CASE WHEN m.commits_to_date >= 3 THEN count(*) FILTER (first_index = m.month_index) ELSE 0 END AS first_ever
  FROM chosen m LEFT JOIN core USING (project_name, month_index) GROUP BY m.project_name, m.project_type, m.month, m.month_index, m.commits_this_month, m.commits_to_date),
monthly AS (SELECT *, coalesce(lag(core) OVER (PARTITION BY project_name ORDER BY month_index), []) AS previous FROM grouped),
final AS (SELECT project_name, project_type, month, month_index, commits_this_month, commits_to_date, len(core) AS core_size, len(previous) AS previous_size, first_ever,
  len(core) - len(list_intersect(core, previous)) AS entered FROM monthly),
m AS (SELECT *, CASE WHEN previous_size > 0 THEN entered / previous_size ELSE 0.0 END AS transition_rate FROM final)"""


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.core_monthly(commits(spark, sf_dir), ["project_name", "project_type"])


@query(f"""{MONTHLY} SELECT project_name, project_type, month, month_index::INT AS month_index, commits_this_month, commits_to_date, core_size::INT AS core_size, entered::INT AS entered, first_ever::INT AS first_ever,
  round(transition_rate, 6) AS transition_rate, sum(first_ever) OVER (PARTITION BY project_name ORDER BY month_index)::BIGINT AS ever_core FROM m""")
def core_monthly_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _monthly(spark, sf_dir)
    return m.select("project_name", "project_type", "month", "month_index", "commits_this_month", "commits_to_date", F.size("core").alias("core_size"), F.size("entered").alias("entered"), F.size("first_ever").alias("first_ever"), "transition_rate", "ever_core")


@query(f"{MONTHLY} SELECT project_name, month, round(transition_rate, 6) AS transition_rate FROM m WHERE first_ever > 0")
def nonzero_month_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.with_transition(_monthly(spark, sf_dir)).select("project_name", "month", "transition_rate")


@query(f"""{MONTHLY} SELECT project_type, count(*) AS n, round(avg(transition_rate), 6) AS mean, round(quantile_cont(transition_rate, 0.5), 6) AS median, round(stddev_samp(transition_rate), 6) AS std FROM m WHERE first_ever > 0 AND previous_size > 0 GROUP BY 1""")
def exclude_initial_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = core.with_transition(_monthly(spark, sf_dir), need_previous=True)
    return stats.quartile_summary(kept, ["project_type"], "transition_rate").select("project_type", "n", "mean", "median", "std")


@query(f"""{MONTHLY} SELECT project_name, month[1:4]::INT AS year, sum(first_ever)::BIGINT AS joined, round(avg(previous_size), 6) AS mean_core, round(CASE WHEN avg(previous_size) > 0 THEN sum(first_ever) / avg(previous_size) ELSE 0 END, 6) AS rate FROM m GROUP BY 1, 2""")
def yearly_transition_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.yearly_transition_rate(_monthly(spark, sf_dir))


@query(f"""{MONTHLY}, z AS (SELECT project_type, count(*) AS months, count(*) FILTER (first_ever = 0) AS zero_months FROM m GROUP BY 1), {yates_sql('z', 'zero_months', 'months - zero_months')}
SELECT project_type, months, zero_months, round(zero_months / months, 6) AS share, round(chi2, 6) AS chi2, round({chi2_p('chi2')}, 6) AS p_value FROM z, yates""")
def zero_month_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.zero_month_share(_monthly(spark, sf_dir))


@query(f"{MONTHLY} SELECT month, project_type, round(avg(transition_rate), 6) AS mean_rate, count(*) AS n FROM m WHERE first_ever > 0 GROUP BY 1, 2")
def monthly_rate_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.monthly_rate_trend(_monthly(spark, sf_dir))


@query(f"""{MONTHLY}, g AS (SELECT project_name, month_index - lag(month_index) OVER (PARTITION BY project_name ORDER BY month_index) AS gap FROM m WHERE first_ever > 0)
SELECT project_name, count(gap) AS gaps, round(avg(gap), 6) AS mean_gap FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def months_between_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.months_between_transitions(_monthly(spark, sf_dir))


# 2.10 statistics, over orders: priority class as group, value in whole thousands, status as metric

LONG = """WITH long AS (SELECT o_orderstatus AS metric, CASE WHEN o_custkey % 3 = 0 THEN 'A' ELSE 'B' END AS grp, floor(o_totalprice / 1000) AS x FROM orders),
pairs AS (SELECT a.metric, a.x AS ax, b.x AS bx, a.n AS an, b.n AS bn FROM (SELECT metric, x, count(*) AS n FROM long WHERE grp = 'A' GROUP BY ALL) a JOIN (SELECT metric, x, count(*) AS n FROM long WHERE grp = 'B' GROUP BY ALL) b USING (metric)),
dom AS (SELECT metric, sum(an * bn) FILTER (ax > bx) AS gt, sum(an * bn) FILTER (ax < bx) AS lt, sum(an * bn) AS total FROM pairs GROUP BY 1),
sizes AS (SELECT metric, count(*) FILTER (grp = 'A') AS n1, count(*) FILTER (grp = 'B') AS n2 FROM long GROUP BY 1)"""


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("metric"), F.when(F.col("o_custkey") % 3 == 0, "A").otherwise("B").alias("grp"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("x"))


U = f"""{LONG}, ties AS (SELECT metric, sum(t * t * t - t)::DOUBLE AS tie_sum FROM (SELECT metric, x, count(*)::DOUBLE AS t FROM long GROUP BY ALL) GROUP BY 1),
us AS (SELECT metric, n1, n2, (gt + (total - gt - lt) / 2)::DOUBLE AS u, sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - tie_sum / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))) AS sd FROM dom JOIN sizes USING (metric) JOIN ties USING (metric))"""


@query(f"{U} SELECT metric, n1, n2, round(u, 6) AS u, round(z, 6) AS z, round({normal_p('greatest(z, 0)')}, 6) AS p_value FROM (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd AS z FROM us)")
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mann_whitney_u(_long(spark, sf_dir), "grp", "x", "A", "B", ["metric"])


LABEL = "CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS label"


@query(f"{LONG}, d AS (SELECT metric, n1, n2, 2.0 * gt / (n1 * n2) - 1 AS delta FROM dom JOIN sizes USING (metric)) SELECT metric, n1, n2, round(delta, 6) AS delta, {LABEL} FROM d")
def cliffs_delta_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cliffs_delta_strict(_long(spark, sf_dir), "grp", "x", "A", "B", ["metric"])


@query(f"{LONG}, d AS (SELECT metric, n1, n2, (lt - gt) / (n1 * n2) AS delta FROM dom JOIN sizes USING (metric)) SELECT metric, n1, n2, round(delta, 6) AS delta, {LABEL} FROM d")
def cliffs_delta_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cliffs_delta_ties(_long(spark, sf_dir), "grp", "x", "A", "B", ["metric"])


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_discount * 6) < 0.147 THEN 'negligible' WHEN abs(l_discount * 6) < 0.33 THEN 'small' WHEN abs(l_discount * 6) < 0.474 THEN 'medium' ELSE 'large' END AS effect,
  CASE WHEN l_tax < 0.001 THEN '***' WHEN l_tax < 0.01 THEN '**' WHEN l_tax < 0.05 THEN '*' ELSE 'ns' END AS stars FROM lineitem""")
def effect_label_and_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.effect_label(F.col("l_discount") * 6).alias("effect"), C.significance_stars(F.col("l_tax")).alias("stars"))


@query("""WITH t AS (SELECT o_orderpriority AS metric, count(*) FILTER (o_custkey % 3 = 0 AND o_orderstatus = 'F') AS yes1, count(*) FILTER (o_custkey % 3 = 0 AND o_orderstatus <> 'F') AS no1,
  count(*) FILTER (o_custkey % 3 <> 0 AND o_orderstatus = 'F') AS yes2, count(*) FILTER (o_custkey % 3 <> 0 AND o_orderstatus <> 'F') AS no2 FROM orders GROUP BY 1),
f AS (SELECT *, yes1::DOUBLE AS a, no1::DOUBLE AS b, yes2::DOUBLE AS c, no2::DOUBLE AS d FROM t),
g AS (SELECT *, (a + b + c + d) * pow(abs(a * d - b * c) - least((a + b + c + d) / 2, abs(a * d - b * c)), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) AS x FROM f)
SELECT metric, yes1, no1, yes2, no2, round(x, 6) AS chi2, round(""" + chi2_p("x") + ", 6) AS p_value FROM g")
def chi_square_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("metric"), F.when(F.col("o_custkey") % 3 == 0, "A").otherwise("B").alias("grp"), (F.col("o_orderstatus") == "F").alias("yes"))
    return stats.chi_square_2x2(o, "grp", F.col("yes"), "A", "B", ["metric"])


RANKS = """WITH long AS (SELECT o_orderstatus AS metric, o_orderpriority AS grp, floor(o_totalprice / 1000) AS x FROM orders),
mid AS (SELECT metric, grp, rank() OVER (PARTITION BY metric ORDER BY x) + (count(*) OVER (PARTITION BY metric, x) - 1) / 2.0 AS r FROM long),
ties AS (SELECT metric, sum(t * t * t - t) AS ts, sum(t) AS n FROM (SELECT metric, x, count(*)::DOUBLE AS t FROM long GROUP BY ALL) GROUP BY 1),
g AS (SELECT metric, grp, count(*)::DOUBLE AS k, sum(r) AS rs FROM mid GROUP BY ALL)"""


def _ranked_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("metric"), F.col("o_orderpriority").alias("grp"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("x"))


@query(f"""{RANKS}, kw AS (SELECT metric, count(*) AS groups, any_value(n)::BIGINT AS total, (12 / (any_value(n) * (any_value(n) + 1)) * sum(rs * rs / k) - 3 * (any_value(n) + 1)) / (1 - any_value(ts) / (pow(any_value(n), 3) - any_value(n))) AS h0, count(*) - 1 AS df FROM g JOIN ties USING (metric) GROUP BY metric)
SELECT metric, groups, total, round(h0, 6) AS h, df, round({chi2_p('h0', 'df')}, 6) AS p_value FROM kw""")
def kruskal_wallis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.kruskal_wallis(_ranked_long(spark, sf_dir), "grp", "x", ["metric"])


@query(f"""{RANKS}, dn AS (SELECT a.metric, a.grp AS group_a, b.grp AS group_b, (a.rs / a.k - b.rs / b.k) / sqrt((n * (n + 1) / 12 - ts / (12 * (n - 1))) * (1 / a.k + 1 / b.k)) AS z0
FROM g a JOIN g b ON a.metric = b.metric AND a.grp < b.grp JOIN ties ON ties.metric = a.metric)
SELECT metric, group_a, group_b, round(z0, 6) AS z, round({normal_p('z0')}, 6) AS p_value FROM dn""")
def dunn_posthoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dunn_posthoc(_ranked_long(spark, sf_dir), "grp", "x", ["metric"])


@query(f"""WITH RECURSIVE long AS (SELECT o_orderpriority AS grp, floor(o_totalprice / 1000) AS x FROM orders), mid AS (SELECT grp, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM long),
ties AS (SELECT sum(t * t * t - t) AS ts, sum(t) AS n FROM (SELECT x, count(*)::DOUBLE AS t FROM long GROUP BY 1)), g AS (SELECT grp, count(*)::DOUBLE AS k, sum(r) AS rs, quantile_cont(x, 0.5) AS median FROM mid GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY median, grp) AS i FROM g), pz AS (SELECT a.i AS lo, b.i AS hi, (a.rs / a.k - b.rs / b.k) / sqrt((n * (n + 1) / 12 - ts / (12 * (n - 1))) * (1 / a.k + 1 / b.k)) AS z FROM o a JOIN o b ON a.i < b.i, ties),
p AS (SELECT lo, hi, {normal_p('z')} AS p FROM pz),
walk AS (SELECT 1::BIGINT AS i, 1::BIGINT AS start, 1 AS rank UNION ALL SELECT i + 1, CASE WHEN far THEN i + 1 ELSE start END, CASE WHEN far THEN rank + 1 ELSE rank END FROM (SELECT walk.*, EXISTS (SELECT 1 FROM p WHERE hi = walk.i + 1 AND lo >= walk.start AND p < 0.05) AS far FROM walk WHERE i < (SELECT count(*) FROM o)))
SELECT grp, median, rank::INT AS rank FROM o JOIN walk USING (i)""")
def rank_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _ranked_long(spark, sf_dir)
    medians = {r["grp"]: r["median"] for r in stats.quartile_summary(long, ["grp"], "x").collect()}
    p = {(r["group_a"], r["group_b"]): r["p_value"] for r in stats.dunn_posthoc(long, "grp", "x").collect()}
    ranks = stats.rank_buckets(medians, p)
    return spark.createDataFrame([(g, medians[g], k) for g, k in ranks.items()], "grp string, median double, rank int")


@query("""SELECT o_orderpriority AS grp, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.25), 6) AS q25,
  round(quantile_cont(o_totalprice, 0.75), 6) AS q75, round(stddev_samp(o_totalprice), 4) AS std FROM orders GROUP BY 1""")
def quartile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.quartile_summary(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return out.withColumnRenamed("o_orderpriority", "grp").withColumn("std", F.round("std", 4)).drop("text")


@query(f"""{U}, s AS (SELECT metric, grp, avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_samp(x) AS std FROM long GROUP BY ALL), w AS (SELECT metric, max(mean) FILTER (grp = 'A') AS mean1, max(median) FILTER (grp = 'A') AS median1, max(std) FILTER (grp = 'A') AS std1,
  max(mean) FILTER (grp = 'B') AS mean2, max(median) FILTER (grp = 'B') AS median2, max(std) FILTER (grp = 'B') AS std2 FROM s GROUP BY 1),
d AS (SELECT metric, (lt - gt) / (n1 * n2) AS delta, 2.0 * gt / (n1 * n2) - 1 AS delta_strict FROM dom JOIN sizes USING (metric))
SELECT metric, n1, n2, round(u, 6) AS u, round(z, 6) AS z, round({normal_p('greatest(z, 0)')}, 6) AS p_value, round(mean1, 6) AS mean1, round(median1, 6) AS median1, round(std1, 6) AS std1, round(mean2, 6) AS mean2, round(median2, 6) AS median2, round(std2, 6) AS std2,
  round(delta, 6) AS delta, round(delta_strict, 6) AS delta_strict, {LABEL}, CASE WHEN median1 > median2 THEN 'A' WHEN median1 < median2 THEN 'B' WHEN mean1 > mean2 THEN 'A' WHEN mean1 < mean2 THEN 'B' ELSE 'equal' END AS direction FROM (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd AS z FROM us) JOIN w USING (metric) JOIN d USING (metric)""")
def group_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.group_compare(_long(spark, sf_dir), "grp", "A", "B", min_n=5)


@query(f"""{COUNTS}, core AS (SELECT project_name, count(*) AS k FROM ranked WHERE (cum - n) * 100 < total * 80 GROUP BY 1), people AS (SELECT project_name, count(*) AS m, max(total) AS total FROM ranked GROUP BY 1),
s AS (SELECT DISTINCT c.project_type AS grp, core.project_name, k / m AS x FROM core JOIN people USING (project_name) JOIN (SELECT DISTINCT project_name, project_type FROM commits) c USING (project_name) WHERE total >= 10 AND m >= 3),
p AS (SELECT count(*) FILTER (a.x > b.x) + count(*) FILTER (a.x = b.x) / 2 AS u, 2.0 * count(*) FILTER (a.x > b.x) / count(*) - 1 AS delta FROM s a, s b WHERE a.grp = 'A' AND b.grp = 'B')
SELECT (SELECT count(*) FROM s WHERE grp = 'A') AS n1, (SELECT count(*) FROM s WHERE grp = 'B') AS n2, u::DOUBLE AS u, round(delta, 6) AS delta, round((SELECT quantile_cont(x, 0.5) FROM s WHERE grp = 'A'), 6) AS median1, round((SELECT quantile_cont(x, 0.5) FROM s WHERE grp = 'B'), 6) AS median2 FROM p""")
def core_share_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = core.project_metrics(commits(spark, sf_dir)).select(F.lit("core_ratio").alias("metric"), F.col("project_type").alias("grp"), F.col("core_ratio").alias("x"))
    return stats.group_compare(m, "grp", "A", "B").select("n1", "n2", "u", "median1", "median2", F.col("delta_strict").alias("delta"))
