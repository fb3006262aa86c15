"""Time ranges: trailing windows and their buckets. `now` is always given, never read from a clock."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds per range (0 = everything), bucket seconds, number of buckets.
RANGES = {
    "1h": (3_600, 300, 12),
    "4h": (14_400, 900, 16),
    "1d": (86_400, 3_600, 24),
    "7d": (604_800, 21_600, 28),
    "30d": (2_592_000, 86_400, 30),
    "all": (0, 3_600, 30),
}


@dataclass(frozen=True)
class Range:
    label: str
    now: int

    @property
    def seconds(self) -> int:
        return RANGES[self.label][0]

    @property
    def cutoff(self) -> int:
        return max(self.now - self.seconds, 0) if self.seconds else 0

    @property
    def n_buckets(self) -> int:
        return RANGES[self.label][2]


def earliest(sessions: DataFrame) -> DataFrame:
    """One row: the earliest positive start or end over all given sessions."""
    first = F.least("started_at_ts", "last_active_ts")
    return sessions.agg(F.min(F.when(first > 0, first)).alias("earliest"))


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def spanned(r: Range, sessions: DataFrame) -> Column:
    """A struct: `start` and `width` (s) of the buckets, `hours` of the range.

    For `all` they follow from the earliest session, in one scalar query that is alike wherever it is used. Its buckets
    start there (30 days back without one); its hours go from there to now, 1 at least.
    """
    width = _long(RANGES[r.label][1])
    if r.seconds:
        return F.struct(_long(r.cutoff).alias("start"), width.alias("width"), F.lit(r.seconds / 3600.0).alias("hours"))
    first, now = F.col("earliest"), _long(r.now)
    start = F.coalesce(first, _long(max(r.now - RANGES["30d"][0], 0)))
    part = F.floor(F.greatest(now - start, _long(1)) / r.n_buckets).cast("bigint")
    hours = F.greatest(now - F.coalesce(first, now), _long(0)) / F.lit(3600.0)
    return earliest(sessions).select(
        F.struct(start.alias("start"), F.greatest(part, width).alias("width"), F.greatest(hours, F.lit(1.0)).alias("hours"))
    ).scalar()


def window_hours(r: Range, sessions: DataFrame) -> Column:
    """Length of the range."""
    return spanned(r, sessions)["hours"]


def bucket_start(r: Range, sessions: DataFrame) -> Column:
    return spanned(r, sessions)["start"]


def bucket_seconds(r: Range, sessions: DataFrame) -> Column:
    return spanned(r, sessions)["width"]
