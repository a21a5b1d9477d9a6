"""Users, sessions and activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_users(users: DataFrame, text: str = "", role: str | None = None, status: str | None = None) -> DataFrame:
    if text:
        users = users.where(F.contains(F.lower("email"), F.lit(text.lower())) | F.contains(F.lower("display_name"), F.lit(text.lower())))
    if role:
        users = users.where(F.col("role") == role)
    tests = {"active": "is_active = 1 and is_suspended = 0", "suspended": "is_suspended = 1", "inactive": "is_active = 0"}
    return users.where(tests[status]) if status else users


def live_sessions(sessions: DataFrame, users: DataFrame, now) -> DataFrame:
    """Sessions that have not ended, of users that are active and not suspended."""
    fine = users.where("is_active = 1 and is_suspended = 0").select(F.col("id").alias("user_id"))
    return sessions.where(F.col("expires_at") > now).join(fine, "user_id", "left_semi")


def expired_sessions(sessions: DataFrame, now) -> DataFrame:
    return sessions.where(F.col("expires_at") < now)


def user_overview(users: DataFrame, **facts: DataFrame) -> DataFrame:
    """Per user the number of rows of each fact table named."""
    out = users.select("id", "email")
    for name, fact in facts.items():
        counts = fact.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias(name))
        out = out.join(counts, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def top_users(overview: DataFrame, by: str, n: int = 10) -> DataFrame:
    return overview.orderBy(F.desc(by), "id").limit(n)


def platform_totals(users: DataFrame, live: DataFrame, now, **facts: DataFrame) -> DataFrame:
    """One row: users by kind, live sessions, and the rows of each fact table named."""
    recent = F.col("created_at") >= now - F.expr("INTERVAL 30 DAYS")
    out = users.agg(F.count("*").alias("users"), F.count_if(F.col("is_active") == 1).alias("active"), F.count_if(F.col("role") == "admin").alias("admins"), F.count_if(F.col("is_suspended") == 1).alias("suspended"), F.count_if(recent).alias("new_users"))
    for name, fact in {"live_sessions": live, **facts}.items():
        out = out.crossJoin(fact.agg(F.count("*").alias(name)))  # one row each
    return out


def activity_by_type(activity: DataFrame) -> DataFrame:
    return activity.groupBy("action").agg(F.count("*").alias("n"))


def daily_counts(events: DataFrame, when: str, now, *by: str, days: int = 30) -> DataFrame:
    """Rows a calendar day (and value of the columns `by`), from `days` days back."""
    return events.where(F.col(when) >= now - F.expr(f"INTERVAL {days} DAYS")).groupBy(*by, F.to_date(when).alias("day")).agg(F.count("*").alias("n"))


def activity_with_users(activity: DataFrame, users: DataFrame, n: int = 500) -> DataFrame:
    """The latest `n` entries with who did it. The entries are chosen first, so the join is of `n` rows."""
    last = activity.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return last.join(users.select(F.col("id").alias("user_id"), "email", "display_name"), "user_id", "left").select("id", "action", "created_at", "email", "display_name")


def log_searches(history: DataFrame, asked: DataFrame, results: DataFrame) -> DataFrame:
    """`history` with one row a query (id, user_id, group_id, query, searched_at) that has its number of results."""
    counts = results.groupBy("id").agg(F.count("*").alias("result_count"))
    new = asked.join(counts, "id", "left").select("id", "user_id", "group_id", "query", "searched_at", F.coalesce("result_count", F.lit(0)).alias("result_count"))
    return history.unionByName(new) if history is not None else new
