"""Queries of section 2.1: each writes a table of the driver's data and reads it back through a reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.plans.registry import query
from trailmark.plans.views import COMMITS, commits
from trailmark.sources import readers


def _place(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, or in the warehouse where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


COLUMNS = "project_name, project_type, commit_hash, author_email, commit_date, total_insertions, total_deletions, files_modified_count"
ALL = f"WITH {COMMITS} SELECT {COLUMNS} FROM commits"


@query(ALL)
def scan_commits_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "commits-csv")
    readers.sink_csv(commits(spark, sf_dir).select([f.name for f in readers.COMMITS]), path)
    return readers.scan_commits_csv(spark, path, COLUMNS.split(", "))


#: Commits of one JSON document, about.
COMMITS_A_DOCUMENT = 10_000


@query(ALL)
def scan_commit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, k = _place(spark, "commits-json"), F.col("files_modified_count")
    first = F.struct(F.lit("f").alias("filename"), F.col("total_insertions").cast("string").alias("insertions"), F.col("total_deletions").cast("string").alias("deletions"))
    rest = F.struct(F.lit("binary").alias("filename"), F.lit("-").alias("insertions"), F.lit("-").alias("deletions"))
    files = F.when(k > 0, F.concat(F.array(first), F.array_repeat(rest, (k - 1).cast("int"))))
    one = F.struct(F.col("commit_hash").alias("hash"), "author_name", "author_email", F.date_format("commit_date", "yyyy-MM-dd HH:mm:ss").alias("date"), F.lit("m").alias("message"), files.alias("files_changed"))
    # A large project gets several documents, dealt by hash, so that no row holds many more than COMMITS_A_DOCUMENT.
    project = ["project_name", "project_type"]
    rows = commits(spark, sf_dir).select(*[F.coalesce(c, F.lit("")).alias(f"k{i}") for i, c in enumerate(project)], *project, "commit_hash", one.alias("one"))
    parts = rows.groupBy("k0", "k1").agg(F.ceil(F.count(F.lit(1)) / COMMITS_A_DOCUMENT).alias("parts"))
    dealt = rows.join(parts, ["k0", "k1"]).withColumn("part", F.pmod(F.xxhash64("commit_hash"), "parts"))
    dealt.groupBy(*project, "part").agg(F.collect_list("one").alias("commits")).drop("part").write.option("maxRecordsPerFile", 1).json(path)
    return readers.scan_commit_json(spark, path).select(COLUMNS.split(", "))


@query(f"WITH {COMMITS} SELECT project_name, author_email, CASE WHEN commit_hash::BIGINT % 2 = 0 THEN 'pull_request' ELSE 'issue' END AS event_type, commit_hash AS event_identifier, commit_date AS event_timestamp FROM commits")
def scan_contributor_cache_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "cache-json")
    one = F.struct(F.col("commit_hash").alias("number"), F.date_format("commit_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"))
    pick = lambda m: F.collect_list(F.when(F.col("commit_hash").cast("bigint") % 2 == m, one))
    docs = commits(spark, sf_dir).groupBy("project_name", F.col("author_email").alias("contributor_email")).agg(F.struct(pick(0).alias("pull_requests"), pick(1).alias("issues")).alias("raw_data"))
    # A line holds one document, so there are as many files as tasks, not as people.
    docs.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return readers.scan_contributor_cache_json(spark, path, lines=True).drop("event_data")


@query(f"WITH {COMMITS} SELECT project_name, author_email AS contributor_email, event_id, week AS event_week, event_timestamp, event_data FROM (SELECT project_name, author_email, commit_hash::BIGINT AS event_id, (commit_hash::BIGINT % 9)::INT AS week, commit_date AS event_timestamp, '{{\"k\":\"' || commit_hash || ', \"\"\"}}' AS event_data FROM commits)")
def scan_timeline_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "timeline-csv")
    c = commits(spark, sf_dir)
    rows = c.select(F.col("commit_hash").cast("bigint").alias("event_id"), F.lit("commit").alias("event_type"), F.date_format("commit_date", "yyyy-MM-dd HH:mm:ss").alias("event_timestamp"), (F.col("commit_hash").cast("bigint") % 9).alias("event_week"), F.col("commit_hash").alias("event_identifier"), F.concat(F.lit('{"k":"'), F.col("commit_hash"), F.lit(', """}')).alias("event_data"), "project_name", "project_type", F.col("author_email").alias("contributor_email"), F.lit("u").alias("username"), F.lit(True).alias("is_pre_core"))
    readers.sink_csv(rows, path)
    return readers.scan_timeline_csv(spark, path).select("project_name", "contributor_email", "event_id", "event_week", "event_timestamp", "event_data")


@query(f"WITH {COMMITS} SELECT commit_hash, total_insertions, total_deletions, 2 AS n_features FROM commits")
def scan_and_sink_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "features")
    readers.sink_parquet(commits(spark, sf_dir).select("project_name", "commit_hash", "total_insertions", "total_deletions", F.lit(1).alias("label")), path, ["project_name"])
    frame, names = readers.scan_parquet_features(spark, path, "label", ["commit_hash", "project_name"])
    return frame.select("commit_hash", "total_insertions", "total_deletions", F.lit(len(names)).alias("n_features"))


@query(f"WITH {COMMITS} SELECT project_type AS name, count(*) AS n, round(count(*) / (SELECT count(*) FROM commits), 6) AS share FROM commits GROUP BY 1")
def sink_summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "summary")
    readers.sink_summary_json(commits(spark, sf_dir), path, ts="commit_date")
    rows = spark.read.schema("rows bigint, groups array<struct<name:string,n:bigint,share:double>>").json(path)
    return rows.select(F.explode("groups").alias("g")).select("g.*")
