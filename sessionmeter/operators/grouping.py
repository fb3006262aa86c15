"""Sessions of one agent and directory that belong to one piece of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmeter.operators.ordered import prefix_max, with_neighbours

DEFAULT_GAP = 86_400
# a good hour: 4096 seconds
HOUR_BITS = 12
KEYS = ["agent", "_dir"]


def group_sessions(sessions: DataFrame, gap: int = DEFAULT_GAP) -> DataFrame:
    """Add `group_id` and `group_key`.

    In order of start, a session opens a group when it starts more than `gap` seconds after the latest
    activity of all earlier sessions of its agent and directory.

    One (agent, directory) may hold a large share of all sessions, so the order is worked out on
    distinct start seconds, cut into pieces of 4096 seconds: at most 4096 rows per window, whatever the key.
    """
    rows = _placed(sessions)
    opened = prefix_max(_openings(rows, gap), KEYS, "_start", "_hour", "_open", "_group_start", include_row=True)
    placed = rows.join(
        opened.select(*KEYS, "_start", "_group_start", "_apart"), [*KEYS, "_start"]
    )
    alone = F.when(F.col("_apart"), F.concat(F.lit("|"), F.col("path"))).otherwise(F.lit(""))
    identity = F.concat("agent", F.lit("|"), "_dir", F.lit("|"), F.col("_group_start").cast("string"), alone)
    return placed.select(
        *sessions.columns,
        F.sha2(identity, 256).alias("group_id"),
        F.concat("agent", F.lit("|"), "_dir").alias("group_key"),
    )


def _placed(sessions: DataFrame) -> DataFrame:
    """Sessions with keys that cannot be NULL: branches that use them stay alike and share one shuffle."""
    return sessions.withColumn("_dir", F.coalesce("cwd", F.lit(""))).withColumn(
        "_start", F.coalesce("started_at_ts", F.lit(0).cast("bigint"))
    )


def _openings(rows: DataFrame, gap: int) -> DataFrame:
    """One row per distinct start of a key with `_n` sessions; `_open` is the start where a group opens."""
    start = F.col("_start")
    starts = (
        rows.groupBy(*KEYS, "_start")
        .agg(F.max("last_active_ts").alias("_end"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_hour", F.shiftright(start, HOUR_BITS))
    )
    seen = prefix_max(starts, KEYS, "_start", "_hour", "_end", "_seen", include_row=False)
    opens = F.col("_seen").isNull() | (start - F.col("_seen") > gap)
    # where even the latest end of this very second lies a gap back, no two sessions of it stay together
    apart = start - F.greatest("_seen", "_end") > gap
    return seen.withColumn("_open", F.when(opens, start)).withColumn("_apart", apart)


def group_count(sessions: DataFrame, gap: int = DEFAULT_GAP) -> DataFrame:
    """One row, `groups`: counted where groups open, without placing any session in one."""
    here = F.when(F.col("_apart"), F.col("_n")).when(F.col("_open").isNotNull(), 1).otherwise(0)
    return _openings(_placed(sessions), gap).agg(F.coalesce(F.sum(here), F.lit(0)).cast("bigint").alias("groups"))


def member_order() -> list[Column]:
    """Most recent first; ties by start, then id."""
    return [F.desc("last_active_ts"), F.asc("started_at_ts"), F.asc("session_id"), F.asc("path")]


def last_member() -> Column:
    """Sort key whose maximum is the last member in member order, the least recently active one."""
    return F.struct(-F.col("last_active_ts"), F.col("started_at_ts"), F.col("session_id"), F.col("path"))


def groups(grouped: DataFrame) -> DataFrame:
    """One row per group, most recent first."""
    return (
        grouped.groupBy("group_id")
        .agg(
            F.min("group_key").alias("group_key"),
            F.min("agent").alias("agent"),
            F.min("cwd").alias("cwd"),
            F.count(F.lit(1)).alias("n_sessions"),
            F.max("last_active_ts").alias("latest_active_ts"),
            F.min("started_at_ts").alias("first_started_ts"),
        )
        .orderBy(F.desc("latest_active_ts"), "group_key", "first_started_ts", "group_id")
    )


def members(grouped: DataFrame) -> DataFrame:
    """Position n of m in the group, with the neighbours (itself at either end)."""
    narrow = grouped.select("group_id", "agent", "session_id", "path", "last_active_ts", "started_at_ts")
    placed = with_neighbours(narrow, ["group_id"], member_order(), "session_id")
    return placed.select(
        "group_id", "agent", "session_id", "path", "last_active_ts",
        F.col("_row").cast("bigint").alias("position"),
        F.col("_rows").alias("n_members"),
        F.coalesce("_before", "session_id").alias("previous_id"),
        F.coalesce("_after", "session_id").alias("next_id"),
    )
