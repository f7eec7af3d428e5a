"""Queries of section 2.8: milestones, sequences, flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.columns import wilson_lower_bound as wilson
from trailmark.operators import flows, milestones
from trailmark.plans.registry import query
from trailmark.plans.sql_tails import chi2_p, yates_sql
from trailmark.plans.views import SPARSE, TIMELINE, sparse_timeline, table, timeline


def weeks(view: str) -> str:
    return f"wk AS (SELECT *, floor(date_diff('day', coalesce(min(event_timestamp) FILTER (event_type = 'commit') OVER (PARTITION BY person), min(event_timestamp) OVER (PARTITION BY person))::DATE, event_timestamp::DATE) / 7)::INT AS event_week FROM {view})"


SUSTAINED = """active AS (SELECT DISTINCT person, event_week FROM wk), ends AS (SELECT person, min(event_week) AS a, max(event_week) AS b FROM active GROUP BY 1),
starts AS (SELECT person, unnest(range(a, b - 10)) AS s FROM ends WHERE b - a >= 11), sustained AS (SELECT person, min(s + 11)::INT AS sustained_week FROM (SELECT starts.person, s FROM starts JOIN active ON active.person = starts.person AND event_week BETWEEN s AND s + 11 GROUP BY 1, 2 HAVING count(*) >= 9) GROUP BY 1)"""

ACCEPT = """prs AS (SELECT *, row_number() OVER w AS i, sum((pr_state = 'merged')::INT) OVER w AS k FROM wk WHERE event_type = 'pull_request' WINDOW w AS (PARTITION BY person ORDER BY event_timestamp, event_id)),
lb AS (SELECT *, (k / i + 1.96 * 1.96 / (2 * i) - 1.96 * sqrt((k / i * (1 - k / i) + 1.96 * 1.96 / (4 * i)) / i)) / (1 + 1.96 * 1.96 / i) AS low FROM prs),
acc AS (SELECT person, arg_min(event_timestamp, i) FILTER (i <= 10 AND k * 100 >= i * 67) AS classic, arg_min(event_timestamp, i) FILTER (i >= 3 AND low >= 0.67) AS adjusted,
  CASE WHEN max(i) >= 3 AND max(k) * 100 >= max(i) * 67 THEN arg_max(event_timestamp, i) FILTER (i <= 10) END AS simple FROM lb GROUP BY 1),
accepted AS (SELECT person, coalesce(classic, adjusted, simple) AS acceptance_at, CASE WHEN classic IS NOT NULL THEN 'classic' WHEN adjusted IS NOT NULL THEN 'adjusted' ELSE 'simple' END AS acceptance_variant FROM acc WHERE coalesce(classic, adjusted, simple) IS NOT NULL)"""

RECOVERY = "rec AS (SELECT w.person, min(w.event_timestamp) AS recovery_at FROM wk w JOIN (SELECT person, min(event_timestamp) AS r FROM wk WHERE pr_state = 'closed' GROUP BY 1) f ON f.person = w.person AND w.event_timestamp > r GROUP BY 1)"
ABSENCE = "ret AS (SELECT person, min(event_timestamp) AS return_at FROM (SELECT *, lag(event_timestamp) OVER (PARTITION BY person ORDER BY event_timestamp, event_id) AS b FROM wk) WHERE floor((epoch(event_timestamp) - epoch(b)) / 86400) BETWEEN 90 AND 180 GROUP BY 1)"
DIRECT = "num AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY event_timestamp, event_id) AS i FROM wk), dir AS (SELECT n.person, min(event_timestamp) AS direct_at FROM num n JOIN (SELECT person, max(i) AS p FROM num WHERE event_type = 'pull_request' GROUP BY 1) l ON l.person = n.person AND i > p WHERE event_type = 'commit' GROUP BY 1 HAVING count(*) >= 5)"
MERGED = "fm AS (SELECT person, min(event_timestamp) AS first_merged_at, min(event_week) AS first_merged_week FROM wk WHERE pr_state = 'merged' GROUP BY 1)"


def dense(*parts: str) -> str:
    return ", ".join([f"WITH {TIMELINE}", weeks("timeline"), *parts])


def sparse(*parts: str) -> str:
    return ", ".join([f"WITH {SPARSE}", weeks("sparse"), *parts])


@query(f"{sparse(MERGED)} SELECT * FROM fm")
def first_merged_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return milestones.first_merged_pr(sparse_timeline(spark, sf_dir))


@query(f"{dense(SUSTAINED)} SELECT * FROM sustained")
def sustained_12w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return milestones.sustained_participation(timeline(spark, sf_dir))


@query(f"""{dense("firsts AS (SELECT person, component, min(event_week) AS w FROM wk WHERE event_type = 'pull_request' GROUP BY 1, 2)")} SELECT person, CASE WHEN count(*) >= 5 THEN list_sort(list(w))[5] END AS breadth_week, true AS breadth_supported FROM firsts GROUP BY 1""")
def component_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return milestones.component_breadth(timeline(spark, sf_dir))


@query(f"{sparse(RECOVERY)} SELECT * FROM rec")
def failure_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return milestones.failure_recovery(sparse_timeline(spark, sf_dir))


@query(f"{sparse(ABSENCE)} SELECT * FROM ret")
def return_after_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return milestones.return_after_absence(sparse_timeline(spark, sf_dir))


@query(f"{sparse(ACCEPT)} SELECT * FROM accepted")
def acceptance_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return milestones.acceptance_trajectory(sparse_timeline(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN n > 0 THEN (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((k / n * (1 - k / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n) ELSE 0 END, 6) AS low FROM (SELECT l_orderkey, l_linenumber, l_quantity::INT - 1 AS n, ((l_quantity::INT - 1) * 3 // 4)::INT AS k FROM lineitem)")
def wilson_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_quantity").cast("int") - 1
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", wilson(F.floor(n * 3 / 4), n).alias("low"))


@query(f"{sparse(DIRECT)} SELECT * FROM dir")
def direct_commit_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return milestones.direct_commit_access(sparse_timeline(spark, sf_dir))


ALL = sparse(
    MERGED, SUSTAINED, RECOVERY, ABSENCE, ACCEPT, DIRECT,
    "base AS (SELECT person, any_value(project_type) AS project_type, min(event_timestamp) AS start_at, min(event_week) AS start_week, count(*) AS events FROM wk GROUP BY 1)",
    "ms AS (SELECT * FROM base LEFT JOIN fm USING (person) LEFT JOIN sustained USING (person) LEFT JOIN rec USING (person) LEFT JOIN ret USING (person) LEFT JOIN accepted USING (person) LEFT JOIN dir USING (person))",
)
SEQUENCES = f"""{ALL}, dated AS (SELECT person, first_merged_at AS t, 'FirstMergedPullRequest' AS s FROM ms UNION ALL SELECT person, start_at + (sustained_week - start_week) * INTERVAL 7 DAY, 'SustainedParticipation12w' FROM ms UNION ALL SELECT person, recovery_at, 'FailureRecovery' FROM ms
UNION ALL SELECT person, return_at, 'ReturnAfterExtendedAbsence' FROM ms UNION ALL SELECT person, acceptance_at, 'HighAcceptanceTrajectory' FROM ms WHERE acceptance_variant = 'classic' UNION ALL SELECT person, direct_at, 'DirectCommitAccessProxy' FROM ms),
seqs AS (SELECT person, project_type, 'START' || coalesce(',' || s, '') || ',END' AS sequence FROM ms LEFT JOIN (SELECT person, string_agg(s, ',' ORDER BY t, s) AS s FROM dated WHERE t IS NOT NULL GROUP BY 1) USING (person)),
steps AS (SELECT project_type, l[i] AS src, l[i + 1] AS dst FROM (SELECT project_type, string_split(sequence, ',') AS l, unnest(range(1, len(string_split(sequence, ',')))) AS i FROM seqs))"""


def _milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sparse_timeline(spark, sf_dir)
    return milestones.all_milestones(t, ["person", "project_type"])


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return milestones.milestone_sequences(_milestones(spark, sf_dir), ["person", "project_type"])


@query(f"""{ALL} SELECT count(*) AS people, count(first_merged_at) AS first_merged, count(sustained_week) AS sustained, count(recovery_at) AS recovery, count(return_at) AS "return", count(acceptance_at) AS acceptance, count(direct_at) AS direct,
  count(*) FILTER (acceptance_variant = 'classic') AS acceptance_classic, count(*) FILTER (acceptance_variant = 'adjusted') AS acceptance_adjusted, count(*) FILTER (acceptance_variant = 'simple') AS acceptance_simple FROM ms""")
def milestone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return milestones.milestone_counts(_milestones(spark, sf_dir))


@query(f"""{ALL}, r AS (SELECT project_type, 'merged' AS milestone, first_merged_at IS NOT NULL AS hit, first_merged_week + 1.0 AS week FROM ms UNION ALL SELECT project_type, 'returned', return_at IS NOT NULL, NULL FROM ms),
q AS (SELECT milestone, project_type, count(*) AS people, count(*) FILTER (hit) AS achieved, avg(hit::INT) AS share, quantile_cont(week, 0.25) FILTER (hit) AS a, quantile_cont(week, 0.5) FILTER (hit) AS median_week, quantile_cont(week, 0.75) FILTER (hit) AS b FROM r GROUP BY 1, 2), {yates_sql('q', 'achieved', 'people - achieved', 'milestone')}
SELECT milestone, project_type, people, achieved, round(share, 6) AS share, median_week::DOUBLE AS median_week, (SELECT quantile_cont(week, 0.5) FROM r WHERE r.milestone = q.milestone AND r.project_type = q.project_type AND hit AND week BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))::DOUBLE AS median_week_clean, round(chi2, 6) AS chi2, round({chi2_p('chi2')}, 6) AS p_value FROM q LEFT JOIN yates USING (milestone)""")
def milestone_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return milestones.milestone_rates(_milestones(spark, sf_dir), {"merged": "first_merged_at", "returned": "return_at"}, week={"merged": "first_merged_week"})


@query(f"WITH {SPARSE}, n AS (SELECT person, count(*) AS n FROM sparse GROUP BY 1), t AS (SELECT unnest([0, 1, 5, 10, 15, 20, 25, 50]) AS threshold) SELECT threshold, count(*) FILTER (n >= threshold) AS kept, count(*) FILTER (n < threshold) AS dropped FROM n, t GROUP BY 1")
def precore_activity_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return milestones.precore_activity_sweep(sparse_timeline(spark, sf_dir))


@query(f"{SEQUENCES} SELECT person, project_type, sequence FROM seqs")
def milestone_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).withColumn("sequence", F.array_join("sequence", ","))


@query(f"{SEQUENCES} SELECT project_type, src, dst, count(*) AS n FROM steps GROUP BY 1, 2, 3")
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.transition_counts(_sequences(spark, sf_dir), ["project_type"])


EDGES = f"{SEQUENCES}, full_steps AS (SELECT l[i] AS src, l[i + 1] AS dst FROM (SELECT string_split(sequence, ',') AS l, unnest(range(1, len(string_split(sequence, ',')))) AS i FROM seqs WHERE sequence <> 'START,END')), edges AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM (SELECT src, dst, count(*) AS n FROM full_steps GROUP BY 1, 2)), kept AS (SELECT * FROM edges WHERE p > 0.05)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.transition_probabilities(flows.transition_counts(flows.non_empty(_sequences(spark, sf_dir))))


@query(f"{EDGES} SELECT src, dst, round(p, 6) AS p FROM kept")
def transition_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


PATHS = f"""{EDGES.replace("WITH ", "WITH RECURSIVE ", 1)}, walk AS (SELECT ['START', dst] AS path, dst AS last, p AS probability FROM kept WHERE src = 'START' UNION ALL SELECT list_append(path, dst), dst, probability * p FROM walk JOIN kept ON last = src WHERE last <> 'END' AND NOT list_contains(path, dst)),
top AS (SELECT row_number() OVER (ORDER BY probability DESC, path_text)::INT AS rank, path_text AS path, probability FROM (SELECT array_to_string(path, ' > ') AS path_text, probability FROM walk WHERE last = 'END') QUALIFY rank <= 3)"""


@query(f"{PATHS} SELECT rank, path, round(probability, 6) AS probability, round(-ln(probability), 6) AS cost FROM top")
def top_k_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.top_k_paths(_edges(spark, sf_dir), 3)


@query(f"{PATHS}, used AS (SELECT DISTINCT l[i] AS src, l[i + 1] AS dst FROM (SELECT string_split(path, ' > ') AS l, unnest(range(1, len(string_split(path, ' > ')))) AS i FROM top)) SELECT src, dst, round(p, 6) AS p FROM kept ANTI JOIN used USING (src, dst)")
def path_edge_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return flows.edges_off_paths(edges, flows.top_k_paths(edges, 3))


@query(f"{SEQUENCES} SELECT project_type, state, count(*) AS people FROM (SELECT project_type, unnest(list_distinct(string_split(sequence, ','))) AS state FROM seqs) GROUP BY 1, 2")
def state_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.state_presence(_sequences(spark, sf_dir))


@query(f"""{SEQUENCES}, c AS (SELECT coalesce(project_type, 'overall') AS scope, sequence, count(*) AS n FROM seqs WHERE sequence <> 'START,END' GROUP BY GROUPING SETS ((project_type, sequence), (sequence)))
SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY n DESC, sequence)::INT AS rank, sequence, n, round(n * 100.0 / sum(n) OVER (PARTITION BY scope), 6) AS percent FROM c QUALIFY rank <= 10""")
def common_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.common_sequences(_sequences(spark, sf_dir), drop_empty=True)


@query(f"{SEQUENCES} SELECT count(*) AS total, count(*) FILTER (sequence = 'START,END') AS empty, count(*) FILTER (sequence LIKE 'START,FirstMergedPullRequest%') AS kept_by_prefix FROM seqs")
def sequence_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.sequence_filter_counts(_sequences(spark, sf_dir), ["START", "FirstMergedPullRequest"])


@query(f"{SEQUENCES} SELECT sequence, count(*) AS n, string_agg(person, ',' ORDER BY person) AS members FROM seqs WHERE sequence LIKE '%FailureRecovery%' GROUP BY 1")
def sequences_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.sequences_with_state(_sequences(spark, sf_dir), "FailureRecovery", "person").withColumn("members", F.array_join("members", ","))


#: Texts of the made events, with what they are by hand: (message or title, area of a commit, area of a request).
TEXTS = (("Update README", "documentation", "feature"), ("Add spec for parser", "testing", "feature"), ("PATCH the loader", "bugfix", "feature"), ("Fix doctest", "documentation", "documentation"), ("New widget", "feature", "feature"), ("debugging aid", "bugfix", "bugfix"), ("latest release", "testing", "testing"), (None, "feature", "feature"))
#: Comments, and whether they help.
BODIES = (("You should see this example", 1), ("thanks!", 0), ("HERE'S HOW it works", 1), ("noted", 0), ("prefixes are fine", 1), ("help me", 0), (None, 0))


def _choice(at: str, values) -> str:
    return f"CASE {at} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)) for i, v in enumerate(values)) + " END"


@query(f"""{sparse()}, ev AS (SELECT *, CASE event_type WHEN 'commit' THEN {_choice(f'event_id % {len(TEXTS)}', [t[1] for t in TEXTS])} WHEN 'pull_request' THEN {_choice(f'event_id % {len(TEXTS)}', [t[2] for t in TEXTS])} END AS area,
  row_number() OVER (PARTITION BY person ORDER BY event_timestamp, event_id) AS i, lag(event_timestamp) OVER (PARTITION BY person ORDER BY event_timestamp, event_id) AS b FROM wk),
runs AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY i) AS k FROM ev WHERE event_type = 'commit' OR pr_state = 'merged'),
five AS (SELECT x.person, min(y.i) AS i FROM runs x JOIN runs y ON y.person = x.person AND y.k = x.k + 4 AND date_diff('day', x.event_timestamp::DATE, y.event_timestamp::DATE) <= 90 GROUP BY 1),
heads AS (SELECT person, arg_min(area, i) FILTER (area IS NOT NULL) AS head, min(i) FILTER (pr_state = 'closed') AS shut FROM ev GROUP BY 1),
own AS (SELECT person, min(i) FILTER (pr_state = 'merged') AS accepted, min(i) FILTER (floor((epoch(event_timestamp) - epoch(b)) / 86400) > 30) AS returned, min(i) FILTER (area <> head) AS crossed, min(i) FILTER (pr_state = 'merged' AND i > shut) AS recovered FROM ev JOIN heads USING (person) GROUP BY 1),
msgs AS (SELECT ev.person, ev.i, ev.event_type, CASE WHEN l_suppkey % 3 > 0 THEN 'c' || l_suppkey END AS owner, {_choice(f'l_partkey % {len(BODIES)}', [b[1] for b in BODIES])} AS helps FROM lineitem JOIN ev ON l_orderkey = event_id),
seen AS (SELECT person, min(i) FILTER (event_type = 'pull_request') AS reviewed, min(i) FILTER (event_type <> 'commit' AND helps = 1) AS helped FROM msgs WHERE owner <> person GROUP BY 1),
reached AS (SELECT own.*, five.i AS sustained, reviewed, helped FROM own LEFT JOIN five USING (person) LEFT JOIN seen USING (person))
SELECT reached.person, {', '.join(f"(SELECT event_timestamp FROM ev WHERE ev.person = reached.person AND i = {m}) AS {m}_at, (SELECT event_week FROM ev WHERE ev.person = reached.person AND i = {m}) AS {m}_week" for m in ("accepted", "sustained", "returned", "reviewed", "crossed", "helped", "recovered"))} FROM reached""")
def milestones_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines are reviews of it and comments on it by its customer; the line's supplier owns the thread."""
    pick = lambda c, n, values: F.array(*[F.lit(v) for v in values])[(F.col(c) % n).cast("int")]
    t = sparse_timeline(spark, sf_dir).withColumn("text", pick("event_id", len(TEXTS), [x[0] for x in TEXTS]))
    line = table(spark, sf_dir, "lineitem").join(t.select("person", "event_id"), F.col("l_orderkey") == F.col("event_id"))
    owner = F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("c"), F.col("l_suppkey")))
    said = line.select("person", "event_id", owner.alias("owner"), pick("l_partkey", len(BODIES), [b[0] for b in BODIES]).alias("body"))
    return milestones.milestones_v1(t, said.drop("body"), said)
