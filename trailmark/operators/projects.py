"""Cleaning of identities and times, and tables of projects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.columns import clean_email, count_if, is_blank

#: Owners backed by companies, and owners of community foundations, lower case.
COMPANIES = (
    "google", "googleapis", "google-research", "chromium", "android", "tensorflow", "bazelbuild",
    "microsoft", "azure", "dotnet", "microsoftgraph",
    "meta", "facebook", "fbsamples",
    "uber", "airbnb", "square", "paypal", "stripe", "shopify", "netflix", "linkedin", "oracle", "ibm",
    "adobe", "intel", "nvidia", "bytedance", "alibaba", "baidu", "tencent", "salesforce", "heroku",
    "atlassian", "elastic", "databricks", "confluentinc", "redhat", "aws", "awslabs", "amzn",
    "docker", "hashicorp", "github", "gitlab", "canonical", "jetbrains", "yandex", "spotify",
    "twitter", "x", "pinterest", "dropbox", "cloudflare", "digitalocean", "cisco", "juniper",
    "samsung", "apple", "arm", "sony", "nokia", "wechat", "meituan", "huawei", "antfin",
)
FOUNDATIONS = (
    "apache", "eclipse", "openstack", "mozilla", "linuxfoundation", "cncf", "kubernetes", "lfai",
    "theupdateframework", "cdfoundation", "openjs-foundation", "openjs", "opentelemetry", "opentracing",
    "cloudfoundry", "joomla", "drupal", "gnome", "kde", "qt", "opendaylight",
)


def normalize_identity(commits: DataFrame, project: str = "project_name", email: str = "author_email", name: str = "author_name") -> DataFrame:
    """Lower-cased, trimmed e-mail and trimmed name; rows with a blank e-mail go; adds contributor_id project::email::name."""
    out = commits.where(~is_blank(F.col(email))).withColumn(email, clean_email(F.col(email)))
    out = out.withColumn(name, F.trim(F.coalesce(F.col(name), F.lit(""))))
    return out.withColumn("contributor_id", F.concat_ws("::", project, email, name))


def normalize_timestamps(frame: DataFrame, column: str) -> DataFrame:
    """The column as a UTC timestamp; rows that can't be parsed go."""
    return frame.withColumn(column, F.try_to_timestamp(F.col(column).cast("string"))).where(F.col(column).isNotNull())


def identity_lookup(pairs: DataFrame, activity: DataFrame, commits: DataFrame) -> DataFrame:
    """For (project_name, author_email) pairs: the name behind the first sample commit, else of any commit of that e-mail.

    activity: project_name, author_email, commit_hash; commits: commit_hash, author_email, author_name. source tells
    which way found it ("hash", "email"), null if none did.
    """
    keys = ["project_name", "author_email"]
    first = pairs.join(activity, keys).groupBy(*keys).agg(F.min("commit_hash").alias("commit_hash"))
    by_hash = first.join(commits.groupBy("commit_hash").agg(F.min("author_name").alias("hash_name")), "commit_hash", "left")
    by_mail = commits.groupBy("author_email").agg(F.min("author_name").alias("mail_name"))
    out = pairs.join(by_hash, keys, "left").join(by_mail, "author_email", "left")
    source = F.when(F.col("hash_name").isNotNull(), "hash").when(F.col("mail_name").isNotNull(), "email")
    return out.select(*keys, "commit_hash", F.coalesce("hash_name", "mail_name").alias("author_name"), source.alias("source"))


def bot_shares(commits: DataFrame, group: str = "project_type", message: str | None = None) -> DataFrame:
    """group, commits, bot_commits ("bot" in name or e-mail), bot_pct and, with a message column, bot_messages."""
    named = F.lower(F.concat_ws(" ", "author_name", "author_email")).contains("bot")
    extra = [count_if(F.lower(F.coalesce(F.col(message), F.lit(""))).contains("bot")).alias("bot_messages")] if message else []
    n = F.count(F.lit(1))
    return commits.groupBy(group).agg(n.alias("commits"), count_if(named).alias("bot_commits"), (count_if(named) * 100.0 / n).alias("bot_pct"), *extra)


def owner_class(project: Column, companies: Sequence[str] = COMPANIES, foundations: Sequence[str] = FOUNDATIONS) -> Column:
    """community-led or company-backed by the owner before the slash: unknown for a blank one, community-led if it holds
    "foundation" or is a listed foundation, company-backed if it is a listed company, else community-led."""
    owner = F.lower(F.trim(F.split_part(project, F.lit("/"), F.lit(1))))
    led = owner.contains("foundation") | owner.isin(*foundations)
    return F.when(owner.isNull() | (owner == ""), "unknown").when(led, "community-led").when(owner.isin(*companies), "company-backed").otherwise("community-led")


def owner_class_counts(projects: DataFrame, project: str = "project_name", group: str = "project_type") -> DataFrame:
    return projects.select(group, owner_class(F.col(project)).alias("owner_class")).groupBy(group, "owner_class").agg(F.count(F.lit(1)).alias("projects"))


def project_eligibility(facts: DataFrame, min_contributors: int = 10, min_commits: int = 500, min_closed_prs: int = 50, min_age_days: int = 365, max_idle_days: int = 365) -> DataFrame:
    """Adds a boolean for each criterion and meets_criteria; facts: contributors, commits, closed_prs, age_days, idle_days."""
    tests = {
        "enough_contributors": F.col("contributors") >= min_contributors,
        "enough_commits": F.col("commits") >= min_commits,
        "enough_closed_prs": F.col("closed_prs") >= min_closed_prs,
        "old_enough": F.col("age_days") >= min_age_days,
        "recently_updated": F.col("idle_days") <= max_idle_days,
    }
    out = facts.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in tests.items()})
    meets = F.lit(True)
    for k in tests:
        meets = meets & F.col(k)
    return out.withColumn("meets_criteria", meets)


def project_list_union(lists: Sequence[tuple[str, DataFrame]], project: str = "project_name", failed: DataFrame | None = None) -> DataFrame:
    """The lists' rows with list_source, without the projects of `failed`."""
    tagged = [frame.withColumn("list_source", F.lit(name)) for name, frame in lists]
    out = tagged[0]
    for frame in tagged[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.join(failed.select(project).distinct(), project, "left_anti") if failed is not None else out


def ecosystem_facts(commits: DataFrame, keys: Sequence[str] = ("project_name", "project_type")) -> DataFrame:
    """keys, age_years (days / 365.25), authors, commits, first_commit, last_commit."""
    out = commits.groupBy(*keys).agg(F.count_distinct("author_email").alias("authors"), F.count(F.lit(1)).alias("commits"), F.min("commit_date").alias("first_commit"), F.max("commit_date").alias("last_commit"))
    return out.withColumn("age_years", F.datediff("last_commit", "first_commit") / 365.25)


def contributors_by_group(commits: DataFrame, first: str, second: str, group: str = "project_type", person: str = "author_email") -> DataFrame:
    """One row: total, in_first, in_second, both, only_first, only_second (distinct people)."""
    each = commits.groupBy(person).agg(F.bool_or(F.col(group) == first).alias("a"), F.bool_or(F.col(group) == second).alias("b"))
    return each.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(count_if(F.col("a")), F.lit(0)).alias("in_first"),
        F.coalesce(count_if(F.col("b")), F.lit(0)).alias("in_second"),
        F.coalesce(count_if(F.col("a") & F.col("b")), F.lit(0)).alias("both"),
        F.coalesce(count_if(F.col("a") & ~F.col("b")), F.lit(0)).alias("only_first"),
        F.coalesce(count_if(F.col("b") & ~F.col("a")), F.lit(0)).alias("only_second"),
    )


def names_per_email(commits: DataFrame, core_names: DataFrame | None = None) -> DataFrame:
    """One row: emails, names, max_names_per_email, max_emails_per_name and, with (author_name) core names, matched_rate."""
    mails = commits.groupBy("author_email").agg(F.count_distinct("author_name").alias("k")).agg(F.count(F.lit(1)).alias("emails"), F.max("k").alias("max_names_per_email"))
    names = commits.groupBy("author_name").agg(F.count_distinct("author_email").alias("k")).agg(F.count(F.lit(1)).alias("names"), F.max("k").alias("max_emails_per_name"))
    out = mails.crossJoin(names)  # one row each
    if core_names is not None:
        known = commits.select("author_name").distinct().withColumn("known", F.lit(1))
        rate = core_names.select("author_name").distinct().join(known, "author_name", "left").agg(F.avg(F.when(F.col("known") == 1, 1.0).otherwise(0.0)).alias("matched_rate"))
        out = out.crossJoin(rate)
    return out
