"""Queries of section 2.6: survival analysis of the journeys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import survival
from trailmark.operators.written import written
from trailmark.plans.q_journeys import JOURNEYS, _journeys
from trailmark.plans.registry import query
from trailmark.plans.sql_tails import chi2_p

COVARIATES = ["is_second", "log_commits", "log_lines", "rate", "second_x_commits"]
SURV = f"""{JOURNEYS}, sv AS (SELECT *, time_to_event_weeks::DOUBLE AS duration, became_core::INT AS event, active_before / CASE WHEN became_core THEN weeks_to_core + 1 ELSE last_observed_week - first_commit_week + 1 END AS consistency FROM j WHERE time_to_event_weeks > 0)"""


def _survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.survival_table(_journeys(spark, sf_dir))


@query(f"{SURV} SELECT project_name, author_email, project_type, duration, event FROM sv")
def survival_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survival(spark, sf_dir).select("project_name", "author_email", "project_type", "duration", "event")


@query(f"""{SURV}, q AS (SELECT quantile_cont(total_commits, 0.25) AS a, quantile_cont(total_commits, 0.75) AS b, quantile_cont(consistency, 0.5) AS m FROM sv), t AS (SELECT 'all' AS subset, event FROM sv UNION ALL SELECT lower(project_type), event FROM sv
UNION ALL SELECT 'high_activity', event FROM sv, q WHERE total_commits >= b UNION ALL SELECT 'low_activity', event FROM sv, q WHERE total_commits <= a UNION ALL SELECT 'consistent', event FROM sv, q WHERE consistency >= m) SELECT subset, count(*) AS n, sum(event)::BIGINT AS events FROM t GROUP BY 1""")
def survival_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.survival_subsets(_survival(spark, sf_dir)).groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("events"))


@query(f"""{SURV}, q AS (SELECT quantile_cont(total_commits, 0.25) AS a, quantile_cont(total_commits, 0.75) AS b FROM sv)
SELECT CASE WHEN total_commits <= a THEN 'Low' WHEN total_commits <= b THEN 'Medium' ELSE 'High' END AS activity_group, CASE WHEN first_commit_week <= 10 THEN 'Early' WHEN first_commit_week <= 50 THEN 'Mid' ELSE 'Late' END AS joiner_group, count(*) AS n FROM sv, q GROUP BY 1, 2""")
def activity_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.with_strata(_survival(spark, sf_dir)).groupBy("activity_group", "joiner_group").agg(F.count(F.lit(1)).alias("n"))


KM = f"""{SURV}, r AS (SELECT project_type, duration, sum(event)::BIGINT AS events, count(*) AS leaving FROM sv GROUP BY 1, 2), k AS (SELECT *, sum(leaving) OVER (PARTITION BY project_type ORDER BY duration ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS at_risk FROM r),
km AS (SELECT *, CASE WHEN max((events = at_risk)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w) END AS survival, sqrt(sum(CASE WHEN events < at_risk THEN events / (at_risk * (at_risk - events)) ELSE 0 END) OVER w) AS g FROM k WINDOW w AS (PARTITION BY project_type ORDER BY duration))"""


@query(f"{KM} SELECT project_type, duration, events, leaving, at_risk, round(survival, 6) AS survival, round(survival * g, 6) AS std_error, round(greatest(0, survival - 1.96 * survival * g), 6) AS lower, round(least(1, survival + 1.96 * survival * g), 6) AS upper FROM km")
def kaplan_meier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.kaplan_meier(_survival(spark, sf_dir))


@query(f"{KM} SELECT project_type, min(duration) FILTER (survival <= 0.5) AS median, {', '.join(f'round(coalesce(arg_max(survival, duration) FILTER (duration <= {t}), 1), 6) AS s_{t}' for t in (4, 8, 12, 26, 52, 104))} FROM km GROUP BY 1")
def survival_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.survival_summary(survival.kaplan_meier(_survival(spark, sf_dir)))


@query(f"{KM} SELECT project_type, duration, round(1 - survival, 6) AS incidence FROM km")
def cumulative_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.cumulative_incidence(survival.kaplan_meier(_survival(spark, sf_dir))).select("project_type", "duration", "incidence")


def logrank_sql(source: str, key: str) -> str:
    return f"""lt AS (SELECT {key}, duration, sum(event)::DOUBLE AS d, sum(CASE WHEN project_type = 'A' THEN event ELSE 0 END)::BIGINT AS d1, count(*) AS c, count(*) FILTER (project_type = 'A') AS c1 FROM {source} GROUP BY ALL),
ln AS (SELECT *, sum(c) OVER w::DOUBLE AS n, sum(c1) OVER w::DOUBLE AS n1 FROM lt WINDOW w AS (PARTITION BY {key} ORDER BY duration ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ls AS (SELECT {key}, sum(d1)::BIGINT AS observed, sum(d * n1 / n) AS expected, sum(CASE WHEN n > 1 THEN d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS variance FROM ln GROUP BY 1)"""


@query(f"{SURV}, s0 AS (SELECT 0 AS z, * FROM sv), {logrank_sql('s0', 'z')} SELECT observed, round(expected, 6) AS expected, round(variance, 6) AS variance, round(pow(observed - expected, 2) / variance, 6) AS chi2, round({chi2_p('pow(observed - expected, 2) / variance')}, 6) AS p_value FROM ls")
def logrank_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.logrank_test(_survival(spark, sf_dir), "A", "B")


@query(f"""{SURV}, t0 AS (SELECT *, unnest([10, 20, 30, 52, 78, 104]) AS cutoff FROM sv), t1 AS (SELECT cutoff, project_type, duration, CASE WHEN duration = cutoff THEN 0 ELSE event END AS event FROM t0 WHERE duration <= cutoff), {logrank_sql('t1', 'cutoff')}
SELECT cutoff, 2 AS groups, observed::DOUBLE AS observed, round(expected, 6) AS expected, round(pow(observed - expected, 2) / variance, 6) AS chi2, 1::BIGINT AS df, round({chi2_p('pow(observed - expected, 2) / variance')}, 6) AS p_value FROM ls WHERE cutoff IN (SELECT cutoff FROM t1 GROUP BY 1 HAVING count(*) FILTER (project_type = 'A') > 10 AND count(*) FILTER (project_type = 'B') > 10)""")
def truncated_logrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.truncated_logrank(_survival(spark, sf_dir), ["A", "B"])


@query(f"{SURV} SELECT round(avg(event) FILTER (project_type = 'A'), 6) AS rate_first, round(avg(event) FILTER (project_type = 'B'), 6) AS rate_second, round(avg(event) FILTER (project_type = 'B') / avg(event) FILTER (project_type = 'A'), 6) AS ratio FROM sv")
def event_rate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.event_rate_ratio(_survival(spark, sf_dir), "A", "B")


@query(f"""{SURV} SELECT a.project_type, count(*) AS pairs, count(*) FILTER (a.total_commits > b.total_commits) AS concordant, count(*) FILTER (a.total_commits = b.total_commits) AS tied, round((count(*) FILTER (a.total_commits > b.total_commits) + count(*) FILTER (a.total_commits = b.total_commits) / 2) / count(*), 6) AS index
FROM sv a JOIN sv b ON a.project_type = b.project_type AND a.event = 1 AND b.duration > a.duration GROUP BY 1""")
def concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.concordance(_survival(spark, sf_dir), ["project_type"], "total_commits")


@query()
def cox_ph(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = written(survival.cox_frame(_survival(spark, sf_dir), "B"))
    return survival.cox_models(frame, COVARIATES)


@query()
def cox_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = written(survival.cox_frame(_survival(spark, sf_dir), "B"))
    people = spark.createDataFrame([("first, mean", 0.0, 0.0, 0.0), ("second, mean", 1.0, 0.0, 0.0), ("first, active", 0.0, 1.0, 1.0), ("second, active", 1.0, 1.0, 1.0)], "person string, is_second double, log_commits double, rate double")
    model = survival.cox_ph(frame, ["is_second", "log_commits", "rate"])
    return survival.cox_predict(model, frame, people)


@query()
def ph_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = written(survival.cox_frame(_survival(spark, sf_dir), "B"))
    return survival.ph_test(survival.cox_ph(frame, COVARIATES), frame)


@query()
def concordance_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = written(survival.cox_frame(_survival(spark, sf_dir), "B"))
    return survival.concordance_cv(frame, ["is_second", "log_commits", "rate"], ["project_name", "author_email"])


@query("SELECT unnest(['events_binary', 'durations_positive', 'both_groups', 'event_rate_plausible', 'durations_plausible', 'survival_in_range', 'band_ordered']) AS check, true AS ok")
def survival_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _survival(spark, sf_dir)
    return survival.survival_checks(s, survival.kaplan_meier(s))
