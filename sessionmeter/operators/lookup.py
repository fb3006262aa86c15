"""Filters and lookups over the session list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86_400


def all_sessions(*providers: DataFrame) -> DataFrame:
    """One list of all agents, newest first."""
    return reduce(DataFrame.unionByName, providers).orderBy(F.desc("last_active_ts"), "agent", "session_id", "path")


def filter_sessions(sessions: DataFrame, agent: str | None = None, exclude_scripted: bool = False) -> DataFrame:
    out = sessions if agent is None else sessions.where(F.col("agent") == agent)
    return out.where(~F.col("is_scripted")) if exclude_scripted else out


def by_id_prefix(sessions: DataFrame, prefix: str) -> DataFrame:
    """Sessions whose id starts with the prefix, with the number of matches (1 = resolved)."""
    found = sessions.where(F.startswith("session_id", F.lit(prefix)))
    n = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    return found.select("session_id", "path", n.alias("n_matches")).orderBy("session_id", "path")


def by_cwd(sessions: DataFrame, cwd: str) -> DataFrame:
    return sessions.where(F.col("cwd") == cwd).orderBy(F.desc("last_active_ts"), "session_id", "path")


def by_day(sessions: DataFrame, cwd: str, day_start: int) -> DataFrame:
    """Sessions of a directory last active on the day that starts at `day_start`."""
    at = F.col("last_active_ts")
    return by_cwd(sessions, cwd).where((at >= day_start) & (at < day_start + DAY))
