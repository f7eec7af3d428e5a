"""Readers and writers. Schemas are given, never inferred; bad values become null in permissive reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMITS = T.StructType().add("project_name", "string").add("project_type", "string").add("commit_hash", "string").add("author_name", "string").add("author_email", "string").add("commit_date", "string").add("total_insertions", "string").add("total_deletions", "string").add("files_modified_count", "string")
RAW_COMMITS = "project_name string, project_type string, commits array<struct<hash:string,author_name:string,author_email:string,date:string,message:string,files_changed:array<struct<filename:string,insertions:string,deletions:string>>>>"
TIMELINE = "event_id long, event_type string, event_timestamp string, event_week int, event_identifier string, event_data string, project_name string, project_type string, contributor_email string, username string, is_pre_core boolean"


def require(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame, or an error that names the missing columns."""
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return frame


def scan_commits_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The commits table with a header; numbers that can't be read become 0 and times null. The text columns are read as
    given, and only the wanted ones."""
    raw = spark.read.schema(COMMITS).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    numbers = ("total_insertions", "total_deletions", "files_modified_count")
    out = raw.withColumns({c: F.coalesce(F.expr(f"try_cast({c} as bigint)"), F.lit(0)) for c in numbers}).withColumn("commit_date", F.try_to_timestamp("commit_date"))
    return out.select(*columns) if columns else out


def scan_commit_json(spark: SparkSession, path: str) -> DataFrame:
    """One document a project, with commits and their files; line counts are texts, of which "-" counts 0. A row a commit."""
    rows = spark.read.schema(RAW_COMMITS).option("multiLine", True).json(path).select("project_name", "project_type", F.explode("commits").alias("c"))
    files = F.coalesce("c.files_changed", F.array().cast("array<struct<filename:string,insertions:string,deletions:string>>"))
    lines = lambda k: F.aggregate(files, F.lit(0).cast("bigint"), lambda t, f: t + F.coalesce(f[k].try_cast("bigint"), F.lit(0)))
    return rows.select("project_name", "project_type", F.col("c.hash").alias("commit_hash"), "c.author_name", "c.author_email", F.try_to_timestamp("c.date").alias("commit_date"), lines("insertions").alias("total_insertions"), lines("deletions").alias("total_deletions"), F.size(files).cast("bigint").alias("files_modified_count"))


def scan_contributor_cache_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One JSON text a contributor, each a file or, with `lines`, each a line of larger files: project_name, author_email, event_type, event_identifier, event_timestamp and event_data
    (JSON text) of raw_data.pull_requests[] and raw_data.issues[]. Broken texts give no rows."""
    v = F.try_parse_json("value")
    rows = spark.read.text(path, wholetext=not lines).select(v.alias("v")).where("v is not null")
    listed = lambda name, kind: F.coalesce(F.transform(F.try_variant_get("v", f"$.raw_data.{name}", "array<variant>"), lambda x: F.struct(F.lit(kind).alias("event_type"), x.alias("data"))), F.array().cast("array<struct<event_type:string,data:variant>>"))
    each = rows.select(F.try_variant_get("v", "$.project_name", "string").alias("project_name"), F.try_variant_get("v", "$.contributor_email", "string").alias("author_email"), F.explode(F.concat(listed("pull_requests", "pull_request"), listed("issues", "issue"))).alias("e"))
    at = F.coalesce(F.try_variant_get("e.data", "$.createdAt", "string"), F.try_variant_get("e.data", "$.created_at", "string"))
    return each.select("project_name", "author_email", "e.event_type", F.try_variant_get("e.data", "$.number", "string").alias("event_identifier"), F.try_to_timestamp(at).alias("event_timestamp"), F.to_json("e.data").alias("event_data"))


def scan_timeline_csv(spark: SparkSession, path: str) -> DataFrame:
    """All timeline files under a path as one table, with the name of each row's file and contributor_id: what stands between
    "timeline_" and ".csv" in it (project and e-mail, "/" and "@" written as "_" and "_at_"), null for other names. Rows
    without an event type or a time that can be read are skipped, as are files that can't be read."""
    rows = spark.read.schema(TIMELINE).option("header", True).option("mode", "PERMISSIVE").option("escape", '"').option("pathGlobFilter", "*.csv").option("ignoreCorruptFiles", True).csv(path)
    rows = rows.withColumn("event_timestamp", F.try_to_timestamp("event_timestamp")).withColumn("file_name", F.col("_metadata.file_name"))
    named = F.regexp_extract("file_name", r"^timeline_(.+)\.csv$", 1)
    return rows.where(F.col("event_type").isNotNull() & F.col("event_timestamp").isNotNull()).withColumn("contributor_id", F.when(named != "", named))


def scan_parquet_features(spark: SparkSession, path: str, label: str, ids: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The feature table and the names of its feature columns."""
    frame = require(spark.read.parquet(path), [label, *ids])
    return frame, [c for c in frame.columns if c != label and c not in ids]


def sink_csv(frame: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    frame.write.mode("overwrite").option("header", True).option("escape", '"').partitionBy(*partition_by).csv(path)


def sink_parquet(frame: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    frame.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def summary_row(frame: DataFrame, group: str = "project_type", ts: str | None = None) -> DataFrame:
    """One row: rows, counts and shares by group (a sorted array), and the date range."""
    by = frame.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("rows"), F.sort_array(F.collect_list(F.struct(F.col(group).alias("name"), "n"))).alias("g"))
    out = total.select("rows", F.transform("g", lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"), (x["n"] / F.col("rows")).alias("share"))).alias("groups"))
    return out.crossJoin(frame.agg(F.struct(F.min(ts).alias("first"), F.max(ts).alias("last")).alias("dates"))) if ts else out  # one row each


def sink_summary_json(frame: DataFrame, path: str, group: str = "project_type", ts: str | None = None) -> None:
    summary_row(frame, group, ts).coalesce(1).write.mode("overwrite").json(path)
