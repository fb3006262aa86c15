"""Dashboard rollups over the per-session usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmeter.operators.grouping import group_count, group_sessions, last_member
from sessionmeter.operators.usage import usage_sums
from sessionmeter.schema import agent_short

TOP_GROUPS = 20


def _measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("sessions"),
        F.sum("turns").alias("turns"),
        F.sum("session_cost").alias("cost"),
        F.sum("calls").alias("calls"),
    ]


def _rate(hours: Column) -> Column:
    return F.coalesce("calls", F.lit(0)) / F.greatest(hours, F.lit(0.0001))


def totals(active: DataFrame, hours: Column, gap: int) -> DataFrame:
    """One row; zeros when nothing is active."""
    row = active.agg(*_measures())
    return row.select(
        "sessions",
        group_count(active, gap).scalar().alias("groups"),
        F.coalesce("turns", F.lit(0)).alias("turns"),
        F.coalesce("cost", F.lit(0.0)).alias("cost"),
        F.coalesce("calls", F.lit(0)).alias("calls"),
        hours.alias("window_hours"),
        _rate(hours).alias("calls_per_hour"),
    )


def by_agent(active: DataFrame, hours: Column) -> DataFrame:
    return active.groupBy("agent").agg(*_measures()).withColumn("calls_per_hour", _rate(hours)).orderBy("agent")


def by_model(active: DataFrame, hours: Column) -> DataFrame:
    """Sessions without any model stand under `-`."""
    name = F.when(F.col("model") == "", F.lit("-")).otherwise(F.col("model"))
    rows = active.groupBy(name.alias("model")).agg(*_measures(), *usage_sums())
    return rows.withColumn("calls_per_hour", _rate(hours)).orderBy(F.desc("cost"), "model")


def by_group(active: DataFrame, hours: Column, gap: int) -> DataFrame:
    """Cost and calls per session group; the prompt is that of the least recent member.

    `active` is used twice here (grouping and sums), so pass it materialized.
    """
    grouped = group_sessions(active, gap)
    return (
        grouped.groupBy("group_id")
        .agg(
            F.min("agent").alias("agent"),
            F.coalesce(F.min("cwd"), F.lit("")).alias("cwd"),
            F.count(F.lit(1)).alias("n_sessions"),
            F.max_by(F.coalesce("prompt", F.lit("")), last_member()).alias("prompt"),
            F.sum("session_cost").alias("cost"),
            F.sum("calls").alias("calls"),
            F.min("started_at_ts").alias("first_started_ts"),
        )
        .withColumn("calls_per_hour", _rate(hours))
    )


def sorted_groups(groups: DataFrame) -> DataFrame:
    """The groups as a list is shown; nothing that works on groups needs their order."""
    return groups.orderBy(F.desc("cost"), "agent", "cwd", "first_started_ts")


def top_groups(groups: DataFrame, measure: str, n: int = TOP_GROUPS) -> DataFrame:
    """The n largest groups with their share of all groups above zero.

    `groups` is used twice here (total and list); both share its last shuffle.
    """
    value = F.col(measure).cast("double")
    positive = groups.withColumn("value", value).where(F.col("value") > 0)
    whole = positive.agg(F.struct(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))).scalar()
    top = positive.orderBy(F.desc("value"), "agent", "cwd", "first_started_ts").limit(n)
    return top.select(
        "agent", "cwd", "first_started_ts", "n_sessions", "value",
        (F.col("value") * 100.0 / whole["total"]).alias("share"),
        whole["n"].alias("groups_above_zero"),
    )


def index_counts(sessions: DataFrame) -> DataFrame:
    """Sessions and scripted sessions per agent."""
    return (
        sessions.groupBy(agent_short(F.col("agent")).alias("agent"))
        .agg(F.count(F.lit(1)).alias("sessions"), F.count_if("is_scripted").alias("scripted"))
        .orderBy("agent")
    )


def newest_sessions(sessions: DataFrame, n: int = 5) -> DataFrame:
    return (
        sessions.orderBy(F.desc("last_active_ts"), "session_id", "path")
        .limit(n)
        .select(
            agent_short(F.col("agent")).alias("agent"), "session_id", "turns",
            F.substring(F.coalesce("prompt", F.lit("")), 1, 60).alias("prompt"),
        )
    )


def group_size_histogram(groups: DataFrame) -> DataFrame:
    return groups.groupBy(F.col("n_sessions").alias("size")).agg(F.count(F.lit(1)).alias("groups")).orderBy("size")


def largest_groups(groups: DataFrame, n: int = 10) -> DataFrame:
    return (
        groups.orderBy(F.desc("n_sessions"), F.desc("latest_active_ts"), "group_key", "first_started_ts")
        .limit(n)
        .select("n_sessions", "group_key", F.coalesce("cwd", F.lit("-")).alias("cwd"))
    )


def with_subagents(spent: DataFrame) -> DataFrame:
    """Cost and calls of each session together with those of its subagents.

    `spent`: path, parent_path (NULL for a session of its own), session_cost, calls. A subagent whose session has no row
    still counts under that session's path.
    """
    return spent.groupBy(F.coalesce("parent_path", "path").alias("path")).agg(
        F.count_if(F.col("parent_path").isNotNull()).alias("n_subagents"),
        F.sum(F.when(F.col("parent_path").isNull(), F.col("session_cost")).otherwise(0.0)).alias("own_cost"),
        F.sum("session_cost").alias("cost"),
        F.sum("calls").alias("calls"),
    )
