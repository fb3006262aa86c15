"""The whole dashboard of one range, from one pass over the events per part."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sessionmeter.functions.pricing import PriceBook, default_prices
from sessionmeter.functions.ranges import Range, window_hours
from sessionmeter.operators import lookup, rollups, series, usage
from sessionmeter.operators.grouping import DEFAULT_GAP
from sessionmeter.session import materialize


def dashboard(
    token_events: DataFrame,
    sessions: DataFrame,
    r: Range,
    book: PriceBook | None = None,
    agent: str | None = None,
    exclude_scripted: bool = False,
) -> dict[str, DataFrame]:
    """All parts by name; the per-session usage and the bucket sums are computed once and shared."""
    book = book or default_prices()
    kept = lookup.filter_sessions(sessions, agent, exclude_scripted)
    active = materialize(usage.per_session(token_events, kept, r, book))
    sums = materialize(series.bucket_sums(token_events, active, kept, r, book))
    hours = window_hours(r, kept)
    groups = materialize(rollups.by_group(active, hours, DEFAULT_GAP))
    return {
        "totals": rollups.totals(active, hours, DEFAULT_GAP),
        "by_agent": rollups.by_agent(active, hours),
        "by_model": rollups.by_model(active, hours),
        "by_group": rollups.sorted_groups(groups),
        "top_by_cost": rollups.top_groups(groups, "cost"),
        "top_by_rate": rollups.top_groups(groups, "calls_per_hour"),
        "by_time": series.time_series(sums, kept, r),
        "by_time_agent": series.agent_series(sums, kept, r, "event_cost"),
        "by_time_agent_calls": series.agent_series(sums, kept, r, "calls"),
        "peaks": series.agents_by_peak(sums, kept, r, "event_cost"),
    }
