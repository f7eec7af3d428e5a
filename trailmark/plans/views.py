"""Views of the driver's tables in the shapes that the operators read, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a commit of its customer in the project named by the customer's nation; its lines are its files."""
    line = table(spark, sf_dir, "lineitem")
    amount = F.col("l_quantity").cast("int")
    lines = line.groupBy("l_orderkey").agg(F.sum(amount).alias("ins"), F.sum(F.when(F.col("l_returnflag") == "R", amount).otherwise(0)).alias("del"), F.count_distinct("l_partkey").alias("files"))
    people = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    # All three grow: a compressed file under the broadcast bound can be a million rows on the driver.
    both = table(spark, sf_dir, "orders").join(people.hint("merge"), F.col("o_custkey") == F.col("c_custkey")).join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return both.select(
        F.col("n_name").alias("project_name"),
        F.when(F.col("n_regionkey") % 2 == 0, "A").otherwise("B").alias("project_type"),
        F.lower("c_name").alias("author_email"),
        F.col("c_name").alias("author_name"),
        F.col("o_orderkey").cast("string").alias("commit_hash"),
        F.col("o_orderdate").cast("timestamp").alias("commit_date"),
        zero("ins").alias("total_insertions"),
        zero("del").alias("total_deletions"),
        zero("files").alias("files_modified_count"),
    )


COMMITS = """commits AS (
  SELECT n_name AS project_name, CASE WHEN n_regionkey % 2 = 0 THEN 'A' ELSE 'B' END AS project_type, lower(c_name) AS author_email,
    c_name AS author_name, o_orderkey::VARCHAR AS commit_hash, o_orderdate::TIMESTAMP AS commit_date, coalesce(ins, 0)::BIGINT AS total_insertions,
    coalesce(del, 0)::BIGINT AS total_deletions, coalesce(files, 0)::BIGINT AS files_modified_count
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT l_orderkey, sum(l_quantity::INT) AS ins, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity::INT ELSE 0 END) AS del,
    count(DISTINCT l_partkey) AS files FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def wide_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line is a commit of its supplier in the project named by the part's brand: authors of many projects."""
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return both.select(
        F.col("p_brand").alias("project_name"),
        F.when(F.col("p_size") % 2 == 0, "A").otherwise("B").alias("project_type"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("author_email"),
        F.concat(F.lit("n"), F.col("l_suppkey") % 40).alias("author_name"),
        F.col("l_shipdate").cast("timestamp").alias("commit_date"),
    )


WIDE = """wide AS (
  SELECT p_brand AS project_name, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS project_type, 's' || l_suppkey AS author_email,
    'n' || (l_suppkey % 40) AS author_name, l_shipdate::TIMESTAMP AS commit_date FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's lines as events: 1-2 pull requests, 3 issues, else commits; the return flag is the request's state."""
    kind = F.when(F.col("l_linenumber") <= 2, "pull_request").when(F.col("l_linenumber") == 3, "issue").otherwise("commit")
    state = F.when(F.col("l_returnflag") == "A", "merged").when(F.col("l_returnflag") == "R", "closed").otherwise("open")
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return both.select(
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("person"),
        F.when(F.col("s_nationkey") % 2 == 0, "A").otherwise("B").alias("project_type"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
        kind.alias("event_type"),
        F.when(kind == "pull_request", state).alias("pr_state"),
        F.col("l_shipdate").cast("timestamp").alias("event_timestamp"),
        F.col("l_partkey").alias("component"),
    )


TIMELINE = """timeline AS (
  SELECT 's' || l_suppkey AS person, CASE WHEN s_nationkey % 2 = 0 THEN 'A' ELSE 'B' END AS project_type, l_orderkey * 10 + l_linenumber AS event_id,
    CASE WHEN l_linenumber <= 2 THEN 'pull_request' WHEN l_linenumber = 3 THEN 'issue' ELSE 'commit' END AS event_type,
    CASE WHEN l_linenumber <= 2 THEN CASE l_returnflag WHEN 'A' THEN 'merged' WHEN 'R' THEN 'closed' ELSE 'open' END END AS pr_state,
    l_shipdate::TIMESTAMP AS event_timestamp, l_partkey AS component FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def sparse_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as events; the priority gives the type, the status the request's state."""
    kind = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "pull_request").when(F.col("o_orderpriority") == "3-MEDIUM", "issue").otherwise("commit")
    state = F.when(F.col("o_orderstatus") == "F", "merged").when(F.col("o_orderstatus") == "O", "closed").otherwise("open")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("person"),
        F.when(F.col("o_custkey") % 3 == 0, "A").otherwise("B").alias("project_type"),
        F.col("o_orderkey").alias("event_id"),
        kind.alias("event_type"),
        F.when(kind == "pull_request", state).alias("pr_state"),
        F.col("o_orderdate").cast("timestamp").alias("event_timestamp"),
    )


SPARSE = """sparse AS (
  SELECT 'c' || o_custkey AS person, CASE WHEN o_custkey % 3 = 0 THEN 'A' ELSE 'B' END AS project_type, o_orderkey AS event_id,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'pull_request' WHEN o_orderpriority = '3-MEDIUM' THEN 'issue' ELSE 'commit' END AS event_type,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'closed' ELSE 'open' END END AS pr_state,
    o_orderdate::TIMESTAMP AS event_timestamp FROM orders)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a thread of its customer; its lines are replies of their suppliers, in order of line number."""
    # Both grow: sorted, as in commits.
    both = table(spark, sf_dir, "orders").hint("merge").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    role = F.when(F.col("l_linestatus") == "F", "MEMBER").when(F.col("l_returnflag") == "R", "CONTRIBUTOR").otherwise("NONE")
    return both.select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("person"),
        F.col("o_orderkey").alias("thread_id"),
        F.when(F.col("o_orderstatus") == "F", "pull_request").otherwise("issue").alias("event_type"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("l_linenumber").alias("pos"),
        F.when(F.col("l_suppkey") % 10 == 0, F.concat(F.lit("c"), F.col("o_custkey"))).otherwise(F.concat(F.lit("s"), F.col("l_suppkey"))).alias("author"),
        role.alias("role"),
        F.col("l_shipdate").cast("timestamp").alias("replied_at"),
    )


REPLIES = """replies AS (
  SELECT 'c' || o_custkey AS person, o_orderkey AS thread_id, CASE WHEN o_orderstatus = 'F' THEN 'pull_request' ELSE 'issue' END AS event_type,
    o_orderdate::TIMESTAMP AS created_at, l_linenumber AS pos, CASE WHEN l_suppkey % 10 = 0 THEN 'c' || o_custkey ELSE 's' || l_suppkey END AS author,
    CASE WHEN l_linestatus = 'F' THEN 'MEMBER' WHEN l_returnflag = 'R' THEN 'CONTRIBUTOR' ELSE 'NONE' END AS role, l_shipdate::TIMESTAMP AS replied_at
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as thread messages: person, thread_id, pos, author, text."""
    person = F.concat(F.lit("p"), F.col("conv_id") % 50)
    return table(spark, sf_dir, "conversations").select(person.alias("person"), F.col("conv_id").alias("thread_id"), F.col("turn").alias("pos"), F.col("role").alias("author"), F.coalesce("text", F.lit("")).alias("body"))


MESSAGES = """messages AS (SELECT 'p' || (conv_id % 50) AS person, conv_id AS thread_id, turn AS pos, role AS author, coalesce(text, '') AS body FROM conversations)"""
